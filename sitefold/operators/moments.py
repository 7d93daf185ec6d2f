"""Per-site sufficient statistics and how they merge.

A site's statistics come from one wide aggregate (partial and final, one shuffle of a row per task and
site), however many columns there are; only its result is turned into a row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadInput, ColumnNotAllowed, PolicyViolation
from ..frame import SiteFrame, col
from ..policy import Policy

STATS = ("n", "mean", "var", "sum", "min", "max", "missing")


def station_moments(frame: SiteFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """station, [group,] column, n_rows, n, mean, var (of a sample), sum, min, max, missing.

    Groups are told apart by their text; rows without a group are left out.
    """
    frame.require([*columns, *([group] if group else [])])
    df = frame.df.where(frame.value(group).isNotNull()) if group else frame.df
    keys = [col(frame.station).alias("station"), *([frame.value(group).cast("string").alias("group")] if group else [])]
    names = [k for k in ("station", "group") if group or k == "station"]
    return moment_rows(df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *moment_aggregates([frame.number(c) for c in columns])), names, columns)


def moment_aggregates(values: Sequence[Column]) -> list[Column]:
    """The aggregates of each of values, numbered by its place."""
    aggs = []
    for i, x in enumerate(values):
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.var_samp(x).alias(f"var{i}"), F.sum(x).alias(f"sum{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    return aggs


def moment_rows(wide: DataFrame, names: list[str], columns: Sequence[str]) -> DataFrame:
    """A row per column from wide(names, n_rows, moment_aggregates of columns)."""
    each = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in STATS[:-1]], (F.col("n_rows") - F.col(f"n{i}")).alias("missing"))
        for i, c in enumerate(columns)
    ]
    return wide.select(*names, "n_rows", F.explode(F.array(*each)).alias("s")).select(*names, "n_rows", "s.*") if each else _none(wide, names)


def _none(wide: DataFrame, names: list[str]) -> DataFrame:
    kinds = {"n": "long", "missing": "long"}
    return wide.select(*names, "n_rows", F.lit("").alias("column"), *[F.lit(None).cast(kinds.get(s, "double")).alias(s) for s in STATS]).where(F.lit(False))


def merge_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, mean, var: as over all rows of all sites, from (n, mean, var) of each.

    The variance adds what the sites' means spread around the common one, so large means don't cancel.
    A site without values adds nothing; var is null below two values.
    """
    w = Window.partitionBy(*by)
    m = moments.where("n > 0").withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    spread = F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)) + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2))
    return m.groupBy(*by).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.when(F.sum("n") > 1, spread / F.when(F.sum("n") > 1, F.sum("n") - 1)).alias("var"))


def check_rows(frame: SiteFrame, more_than: int) -> None:
    """BadInput if a site has not more rows than this."""
    few = frame.df.groupBy(col(frame.station).alias("station")).count().where(F.col("count") <= more_than).collect()
    if few:
        raise BadInput(f"sites with {more_than} rows or fewer: {sorted(str(r['station']) for r in few)}")


def check_columns(columns: Sequence[str], policy: Policy) -> None:
    """ColumnNotAllowed if the policy does not share one of columns."""
    refused = [c for c in columns if policy.allowed_columns is not None and c not in policy.allowed_columns or c in policy.disallowed_columns]
    if refused:
        raise ColumnNotAllowed(f"columns not shared: {', '.join(refused)}")


def guarded_stations(frame: SiteFrame, columns: Sequence[str], policy: Policy) -> DataFrame:
    """station, n_rows, least_values (of any column), passes: whether a site meets the policy's minimum."""
    aggs = [F.count(frame.value(c)) for c in columns]
    least: Column = F.least(*aggs) if len(aggs) > 1 else aggs[0] if aggs else F.count("*")
    counted = frame.df.groupBy(col(frame.station).alias("station")).agg(F.count("*").alias("n_rows"), least.alias("least_values"))
    return counted.withColumn("passes", (F.col("n_rows") >= policy.min_rows) & (F.col("least_values") >= policy.min_rows))


def check_privacy(frame: SiteFrame, columns: Sequence[str], policy: Policy) -> None:
    """Every rule of the policy on taking part; raises for the first that a site breaks."""
    check_columns(columns, policy)
    bad = guarded_stations(frame, columns, policy).where(~F.col("passes")).collect()
    if bad:
        raise PolicyViolation(f"sites below {policy.min_rows} rows or values: {sorted(str(r['station']) for r in bad)}")
