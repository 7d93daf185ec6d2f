"""One-way analysis of variance over the groups of all sites.

By default every feature has its own row, groups are matched by label and deviations taken from the common
mean. compat="as_written" gives one F of all features together, with deviations between groups taken from
each site's own mean and averaged over k groups rather than k - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame
from ..functions.dist import f_tail_udf
from .moments import merge_moments, station_moments


def _checked(frame: SiteFrame, group: str, features: Sequence[str] | None) -> tuple[SiteFrame, list[str]]:
    frame.require([group])
    names = frame.require(list(features)) if features is not None else [c for c in frame.numeric_columns() if c != group]
    if not names:
        raise BadInput("no features")
    wrong = [c for c in names if not frame.is_numeric(c)]
    if wrong:
        raise BadInput(f"not numeric: {', '.join(wrong)}")
    return frame.complete([group, *names]), names


def anova_partials(frame: SiteFrame, group: str, features: Sequence[str] | None = None) -> DataFrame:
    """station, group, column, n, mean, var over rows complete in the group and all features."""
    frame, names = _checked(frame, group, features)
    return station_moments(frame, names, group).select("station", "group", "column", "n", "mean", "var")


def _within() -> object:
    return F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))


def anova(frame: SiteFrame, group: str, features: Sequence[str] | None = None, combine_features: bool = False, compat: str | None = None) -> DataFrame:
    """column ("*" for all features together), k, n, ss_between, ss_within, ms_between, ms_within, f_statistic, p_value."""
    parts = anova_partials(frame, group, features)
    if compat == "as_written":
        site = merge_moments(parts, ["station", "column"]).select(F.col("station").alias("s"), F.col("column").alias("c"), F.col("mean").alias("center"))
        p = parts.join(site, (parts["station"] == site["s"]) & (parts["column"] == site["c"]))
        sums = p.groupBy("column").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("center"), 2)).alias("ss_between"), _within().alias("ss_within"), F.count_distinct("group").alias("k"), F.sum("n").alias("n"))
        combine_features = True
    else:
        groups = merge_moments(parts, ["group", "column"])
        center = merge_moments(groups, ["column"]).select(F.col("column").alias("c"), F.col("mean").alias("center"))
        g = groups.join(center, groups["column"] == center["c"])
        sums = g.groupBy("column").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("center"), 2)).alias("ss_between"), _within().alias("ss_within"), F.count_distinct("group").alias("k"), F.sum("n").alias("n"))
    if combine_features:
        sums = sums.groupBy(F.lit("*").alias("column")).agg(F.sum("ss_between").alias("ss_between"), F.sum("ss_within").alias("ss_within"), F.max("k").alias("k"), F.max("n").alias("n"))
    between = F.col("k") if compat == "as_written" else F.col("k") - 1
    out = sums.withColumn("ms_between", F.try_divide("ss_between", between)).withColumn("ms_within", F.try_divide("ss_within", F.col("n") - F.col("k")))
    out = out.withColumn("f_statistic", F.try_divide("ms_between", "ms_within"))
    out = out.withColumn("p_value", f_tail_udf("f_statistic", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))
    return out.select("column", "k", "n", "ss_between", "ss_within", "ms_between", "ms_within", "f_statistic", "p_value")


def group_statistics(frame: SiteFrame, group: str, features: Sequence[str] | None = None, compat: str | None = None) -> DataFrame:
    """group, column, mean, variance over all sites.

    As written, a group's mean is weighted by its sites' rows, and its variance is the sum of the sites'
    variances times those rows less one.
    """
    parts = anova_partials(frame, group, features)
    if compat != "as_written":
        return merge_moments(parts, ["group", "column"]).select("group", "column", "mean", F.col("var").alias("variance"))
    rows = parts.groupBy("station", "column").agg(F.sum("n").alias("rows"))
    total = rows.groupBy(F.col("column").alias("c")).agg(F.sum("rows").alias("total"))
    p = parts.join(rows, ["station", "column"]).groupBy("group", "column").agg(F.sum(F.col("mean") * F.col("rows")).alias("m"), F.sum(F.col("var") * (F.col("rows") - 1)).alias("variance"))
    return p.join(total, p["column"] == total["c"]).select("group", "column", (F.col("m") / F.col("total")).alias("mean"), "variance")
