"""Descriptive summaries: per site, then merged; one scan for all numeric columns."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadInput, PolicyViolation
from ..frame import SiteFrame, col
from ..policy import Policy
from .moments import check_columns, merge_moments, moment_aggregates, moment_rows, station_moments
from .quantiles import station_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _hide(df: DataFrame, policy: Policy, metrics: Mapping[str, str]) -> DataFrame:
    for metric, column in metrics.items():
        if not policy.shows(metric) and column in df.columns:
            df = df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
    return df


def split_columns(frame: SiteFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """The numeric and the other columns of a request; naming numeric columns makes all others categorical."""
    columns = frame.require(columns) if columns else frame.columns
    if numeric:
        if not set(numeric) <= set(columns):
            raise BadInput("numeric columns must be among the columns")
        chosen = [c for c in columns if c in numeric]
    else:
        chosen = frame.numeric_columns(columns)
    return chosen, [c for c in columns if c not in chosen]


def numeric_station(frame: SiteFrame, columns: Sequence[str], policy: Policy | None = None) -> DataFrame:
    """station, column, count, min, max, sum, missing, mean, var of each site; hidden metrics are null."""
    m = station_moments(frame, columns).withColumnRenamed("n", "count")
    m = m.select("station", "column", "count", "min", "max", "sum", "missing", "mean", "var")
    return _hide(m, policy or Policy(), {"min": "min", "max": "max", "count": "count", "sum": "sum", "missing": "missing", "variance": "var"})


def numeric_summary(frame: SiteFrame, columns: Sequence[str], policy: Policy | None = None) -> DataFrame:
    """column, count, missing, min, max, sum, mean, std over all sites.

    std is merged from the sites' central moments, which equals the second round over deviations from the
    common mean. A hidden metric is null, and std too if variances are hidden.
    """
    return _numeric_summary(station_moments(frame, columns), policy or Policy())


def _numeric_summary(m: DataFrame, policy: Policy) -> DataFrame:
    spread = merge_moments(m, ["column"]).select(F.col("column").alias("_c"), F.sqrt("var").alias("std"))
    sums = m.groupBy("column").agg(F.sum("n").alias("count"), F.sum("missing").alias("missing"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))
    out = sums.join(spread, F.col("column") == F.col("_c"), "left").drop("_c").withColumn("mean", F.try_divide("sum", "count"))
    if not (policy.shows("sum") and policy.shows("count")):
        out = out.withColumn("mean", F.lit(None).cast("double"))
    out = _hide(out, policy, {"min": "min", "max": "max", "count": "count", "sum": "sum", "missing": "missing", "variance": "std"})
    return out.select("column", "count", "missing", "min", "max", "sum", "mean", "std")


def quartiles(frame: SiteFrame, columns: Sequence[str], approximate: bool = False, per_station: bool = True, values: int | None = None) -> DataFrame:
    """station, column, q25, median, q75, iqr: exact with linear interpolation.

    Exact quartiles first count every column's values (unless values names the most there are in a site) and
    take memory that doesn't grow with them; see quantiles.py. approximate=True takes one scan.
    Quartiles are not merged across sites; per_station=False asks for those of all rows together.
    """
    frame.require(columns)
    names = ["station"] if per_station else []
    if approximate:
        at = F.array(*map(F.lit, QUARTILES))
        keys = [col(frame.station).alias("station")] if per_station else []
        wide = frame.df.groupBy(*keys).agg(*[F.percentile_approx(frame.number(c), at, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(columns)])
    else:
        wide = station_quantiles(frame, columns, QUARTILES, per_station, values)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)])
    long = wide.select(*names, F.explode(each).alias("s")).select(*names, "s.column", "s.q")
    q = [F.col("q")[i] for i in range(3)]
    return long.select(*names, "column", q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), (q[2] - q[0]).alias("iqr"))


def quartile_lists(frame: SiteFrame, columns: Sequence[str], values: int | None = None) -> DataFrame:
    """column and, in the order of sites, an array of every site's quartiles and range between them."""
    q = quartiles(frame, columns, values=values)
    return q.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("station", "q25", "median", "q75", "iqr"))).alias("quartiles"))


def categorical_station(frame: SiteFrame, columns: Sequence[str]) -> DataFrame:
    """station, column, count, missing."""
    frame.require(columns)
    aggs = [F.count(frame.value(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    wide = frame.df.groupBy(col(frame.station).alias("station")).agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), (F.col("rows") - F.col(f"n{i}")).alias("missing")) for i, c in enumerate(columns)])
    return wide.select("station", F.explode(each).alias("s")).select("station", "s.*")


def categorical_summary(frame: SiteFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, missing over all sites."""
    return categorical_station(frame, columns).groupBy("column").agg(F.sum("count").alias("count"), F.sum("missing").alias("missing"))


def value_counts_station(frame: SiteFrame, columns: Sequence[str]) -> DataFrame:
    """station, column, value (as text), n; nulls are not counted."""
    frame.require(columns)
    each = F.array(*[F.struct(F.lit(c).alias("column"), frame.value(c).cast("string").alias("value")) for c in columns])
    long = frame.df.select(col(frame.station).alias("station"), F.explode(each).alias("s")).where("s.value IS NOT NULL")
    return long.groupBy("station", "s.column", "s.value").agg(F.count("*").alias("n"))


def _with_least(counts: DataFrame, policy: Policy) -> DataFrame:
    """counts with hidden: whether the site's rarest value of the column is below the threshold, or nothing is shown."""
    least = F.min("n").over(Window.partitionBy("station", "column"))
    return counts.withColumn("hidden", (least < policy.privacy_threshold) | F.lit(not policy.shows("counts_unique_values")))


def value_counts_masked(frame: SiteFrame, columns: Sequence[str], policy: Policy | None = None) -> DataFrame:
    """value_counts_station without the columns of a site in which any value is rarer than the threshold."""
    return _with_least(value_counts_station(frame, columns), policy or Policy()).where(~F.col("hidden")).drop("hidden")


def value_counts(frame: SiteFrame, columns: Sequence[str], policy: Policy | None = None) -> DataFrame:
    """column, value, n over the sites that show the column, and n_masked_stations that don't.

    The counts are one aggregate of one scan, used twice.
    """
    counts = _with_least(value_counts_station(frame, columns), policy or Policy())
    masked = counts.groupBy("column", "station").agg(F.bool_or("hidden").alias("hidden")).groupBy("column").agg(F.count_if("hidden").alias("n_masked_stations"))
    shown = counts.where(~F.col("hidden")).groupBy("column", "value").agg(F.sum("n").alias("n"))
    return shown.join(masked, "column").select("column", "value", "n", "n_masked_stations")


def mean_by_category(frame: SiteFrame, category: str, value: str) -> DataFrame:
    """category, mean of value over all sites; rows without a category are left out."""
    frame.require([category, value])
    return frame.df.where(frame.value(category).isNotNull()).groupBy(frame.value(category).alias("category")).agg(F.avg(frame.number(value)).alias("mean"))


def complete_rows(frame: SiteFrame, columns: Sequence[str] | None = None, policy: Policy | None = None) -> DataFrame:
    """station, complete_rows: rows with a value in every column; null if hidden."""
    columns = frame.require(columns) if columns else frame.columns
    full = F.lit(True)
    for c in columns:
        full = full & frame.value(c).isNotNull()
    out = frame.df.groupBy(col(frame.station).alias("station")).agg(F.count_if(full).alias("complete_rows"))
    return _hide(out, policy or Policy(), {"num_complete_rows": "complete_rows"})


def ssd_about(frame: SiteFrame, means: Mapping[str, float | None], policy: Policy | None = None) -> DataFrame:
    """station, column, ssd: squared deviations from given means, values missing left out; null if hidden."""
    policy = policy or Policy()
    columns = frame.require(list(means))
    aggs = [F.sum(F.pow(frame.number(c) - F.lit(means[c]), 2)).alias(f"s{i}") for i, c in enumerate(columns)]
    wide = frame.df.groupBy(col(frame.station).alias("station")).agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("ssd")) for i, c in enumerate(columns)])
    return _hide(wide.select("station", F.explode(each).alias("s")).select("station", "s.*"), policy, {"variance": "ssd"})


def cast_numeric(frame: SiteFrame, columns: Sequence[str]) -> SiteFrame:
    """columns as double; BadInput naming every column that holds text that is no number."""
    frame.require(columns)
    bad = [F.count_if(col(c).isNotNull() & col(c).try_cast("double").isNull()).alias(f"b{i}") for i, c in enumerate(columns)]
    counts = frame.df.agg(*bad).first() if bad else ()
    wrong = [f"{c} ({n} values)" for c, n in zip(columns, counts, strict=True) if n]
    if wrong:
        raise BadInput(f"not numeric: {', '.join(wrong)}")
    return SiteFrame(frame.df.withColumns({c: col(c).try_cast("double") for c in columns}), frame.station)


@dataclass(frozen=True)
class Summary:
    """numeric, quartiles, categorical, value_counts, complete_rows: tidy frames, null where nothing was asked."""

    numeric: DataFrame | None
    quartiles: DataFrame | None
    categorical: DataFrame | None
    value_counts: DataFrame | None
    complete_rows: DataFrame

    def to_dict(self) -> dict:
        """Plain values: {numeric: {column: {...}}, categorical: {...}, counts_unique_values: {...}, num_complete_rows_per_node: [...]}."""
        out: dict = {"numeric": {}, "categorical": {}, "counts_unique_values": {}}
        if self.numeric is not None:
            lists = {r["column"]: [q.asDict() for q in r["quartiles"]] for r in self.quartiles.collect()}
            for r in self.numeric.collect():
                d = r.asDict()
                out["numeric"][d.pop("column")] = d | {k: [q[k] for q in lists[r["column"]]] for k in ("q25", "median", "q75", "iqr")}
        if self.categorical is not None:
            out["categorical"] = {r["column"]: {"count": r["count"], "missing": r["missing"]} for r in self.categorical.collect()}
            for r in self.value_counts.collect():
                out["counts_unique_values"].setdefault(r["column"], {})[r["value"]] = r["n"]
        out["num_complete_rows_per_node"] = [r["complete_rows"] for r in self.complete_rows.orderBy("station").collect()]
        return out

    def to_json(self) -> dict[str, str]:
        """The same parts as JSON texts, the numeric one indented."""
        return {k: json.dumps(v, indent=2 if k == "numeric" else None) for k, v in self.to_dict().items()}


def summary(frame: SiteFrame, columns: Sequence[str] | None = None, numeric: Sequence[str] | None = None, stations: Sequence | None = None, policy: Policy | None = None) -> Summary:
    """All summaries of columns (all, if none are named), after the policy's rules on rows and columns.

    Columns named as numeric may be text that holds numbers; numeric ones that aren't named are categorical.
    One aggregate of one scan gives a row per site, which comes back and serves the rules and all parts but
    quartiles and value counts.
    """
    policy = policy or Policy()
    frame = frame.include(stations)
    numbers, others = split_columns(frame, columns, numeric)
    everything = list(columns or frame.columns)
    check_columns(everything, policy)
    text = [c for c in numbers if not frame.is_numeric(c)]
    cast = {c: col(c).try_cast("double") for c in text}
    value = {c: F.nanvl(cast[c], F.lit(None)) if c in cast else frame.value(c) for c in everything}
    full = F.lit(True)
    for c in everything:
        full = full & value[c].isNotNull()
    counts = [F.count(frame.value(c)).alias(f"known{i}") for i, c in enumerate(everything)]
    bad = [F.count_if(col(c).isNotNull() & cast[c].isNull()).alias(f"bad{i}") for i, c in enumerate(text)]
    found = frame.df.groupBy(col(frame.station).alias("station")).agg(
        F.count("*").alias("n_rows"), *counts, *bad, F.count_if(full).alias("complete_rows"), *moment_aggregates([value[c] if c in cast else frame.number(c) for c in numbers])
    )
    rows = found.collect()
    below = [str(r["station"]) for r in rows if min([r["n_rows"], *[r[f"known{i}"] for i in range(len(everything))]]) < policy.min_rows]
    if below:
        raise PolicyViolation(f"sites below {policy.min_rows} rows or values: {sorted(below)}")
    wrong = {c: sum(r[f"bad{i}"] for r in rows) for i, c in enumerate(text)}
    if any(wrong.values()):
        raise BadInput(f"not numeric: {', '.join(f'{c} ({n} values)' for c, n in wrong.items() if n)}")
    sites = frame.df.sparkSession.createDataFrame(rows, found.schema)
    if text:
        frame = SiteFrame(frame.df.withColumns(cast), frame.station)
    known = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"known{everything.index(c)}").alias("count")) for c in others])
    return Summary(
        _numeric_summary(moment_rows(sites, ["station"], numbers), policy) if numbers else None,
        quartile_lists(frame, numbers, max([r["n_rows"] for r in rows], default=0)) if numbers else None,
        sites.select("n_rows", F.explode(known).alias("s")).groupBy("s.column").agg(F.sum("s.count").alias("count"), F.sum(F.col("n_rows") - F.col("s.count")).alias("missing")) if others else None,
        value_counts(frame, others, policy) if others else None,
        _hide(sites.select("station", "complete_rows"), policy, {"num_complete_rows": "complete_rows"}),
    )
