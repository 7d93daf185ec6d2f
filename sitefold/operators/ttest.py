"""Pooled two-sample t-tests, of two groups across all sites or of two sites.

A site's (group's) column takes part only with two values or more, so the result is not always that of the
union of rows: merging happens after that rule.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame, col
from ..functions.dist import t_two_sided_udf
from ..policy import Policy
from .moments import merge_moments, station_moments


def _columns(frame: SiteFrame, columns: Sequence[str] | None, group: str | None) -> list[str]:
    if not columns:
        return [c for c in frame.numeric_columns() if c != group]
    frame.require(columns)
    wrong = [c for c in columns if not frame.is_numeric(c, booleans=True)]
    if wrong:
        raise BadInput(f"not numeric: {', '.join(wrong)}")
    return list(columns)


def ttest_partials(frame: SiteFrame, columns: Sequence[str] | None = None, group: str | None = None, compat: str | None = None) -> DataFrame:
    """station, [group,] column, n, mean, var of every cell with two values or more.

    compat="as_written" takes the squared deviations of a site's every row from the group's mean, over the
    group's n - 1; that is (N - 1) var + N (mean - group's mean)^2 of the site's N rows.
    """
    names = _columns(frame, columns, group)
    cells = station_moments(frame, names, group).where("n > 1")
    if group and compat == "as_written":
        s = station_moments(frame, names).select(F.col("station").alias("s"), F.col("column").alias("c"), F.col("n").alias("sn"), F.col("mean").alias("sm"), F.col("var").alias("sv"))
        cells = cells.join(s, (cells["station"] == s["s"]) & (cells["column"] == s["c"]))
        whole = (F.col("sn") - 1) * F.coalesce("sv", F.lit(0.0)) + F.col("sn") * F.pow(F.col("sm") - F.col("mean"), 2)
        cells = cells.withColumn("var", whole / (F.col("n") - 1))
    keys = ["station", "group"] if group else ["station"]
    return cells.select(*keys, "column", "n", "mean", "var")


def pooled_t(sides: DataFrame, first: str, second: str) -> DataFrame:
    """sides(side, column, n, mean, var) -> column, n_a, mean_a, var_a, n_b, mean_b, var_b, dof, t_score, p_value.

    Columns that one side lacks, or with no spread at all, are left out.
    """
    pick = [F.max(F.when(F.col("side") == side, F.col(x))).alias(f"{x}_{k}") for k, side in (("a", first), ("b", second)) for x in ("n", "mean", "var")]
    both = sides.groupBy("column").agg(*pick).where("n_a > 1 AND n_b > 1")
    both = both.withColumn("dof", F.col("n_a") + F.col("n_b") - 2)
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.col("dof")
    error = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    both = both.withColumn("_error", error).where("_error > 0")
    both = both.withColumn("t_score", (F.col("mean_a") - F.col("mean_b")) / F.col("_error")).drop("_error")
    return both.withColumn("p_value", t_two_sided_udf("t_score", F.col("dof").cast("double")))


def ttest(frame: SiteFrame, columns: Sequence[str] | None = None, group: str | None = None, stations: Sequence | None = None, policy: Policy | None = None, compat: str | None = None) -> DataFrame:
    """One row per column. With group, its two values (in the order of their texts) over all sites; without,
    two sites, the first named against the second (or in the order of their names)."""
    policy = policy or Policy()
    frame = frame.include(stations)
    if group:
        frame.require([group])
    # one aggregate tells the sites' rows, and the groups or sites: at most three of these come back, and sites below the rule
    side = frame.value(group).cast("string") if group else col(frame.station)
    cells = frame.df.groupBy(col(frame.station).alias("station"), side.alias("side")).agg(F.count("*").alias("n"))
    few = cells.groupBy("station").agg(F.sum("n").alias("n")).where(F.col("n") <= policy.ttest_min_rows)
    sides = cells.where("side IS NOT NULL" if group else "true").select("side").distinct().limit(3)
    rows = sides.select(F.lit(False).alias("few"), "side").unionByName(few.select(F.lit(True).alias("few"), F.col("station").cast(cells.schema["side"].dataType).alias("side"))).collect()
    below = sorted(str(r["side"]) for r in rows if r["few"])
    if below:
        raise BadInput(f"sites with {policy.ttest_min_rows} rows or fewer: {below}")
    known = sorted((r["side"] for r in rows if not r["few"]), key=lambda x: (x is None, x))
    if len(known) != 2:
        raise BadInput(f"{group!r} must have exactly two values over all sites, found {known}" if group else f"without a group exactly two sites are compared, found {known}")
    parts = ttest_partials(frame, columns, group, compat)
    if group:
        return pooled_t(merge_moments(parts, ["group", "column"]).withColumnRenamed("group", "side"), *known)
    first, second = stations if stations else known
    return pooled_t(parts.withColumnRenamed("station", "side"), first, second)


def to_dict(result: DataFrame) -> dict[str, dict[str, float]]:
    return {r["column"]: {"t_score": r["t_score"], "p_value": r["p_value"]} for r in result.orderBy("column").collect()}


def to_json(result: DataFrame) -> str:
    return json.dumps(to_dict(result))
