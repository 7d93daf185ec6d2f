"""Epigenetic-age clocks: linear models over probes, and their statistics over sites."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame, col

# The wording of the table of means.
GLOBAL = "Global (Weighted)"
SITE = "Organization "
TITLE = "EPIGENETIC AGE SUMMARY - ORGANIZATION MEANS"
NOTHING = "No data available to create summary table"
RULE = "=" * 80

#: How a linear score becomes an age.
LINKS = ("identity", "horvath")
#: The age at which the second link passes from exponential to linear.
ADULT = 20


def _linked(x: Column, link: Column) -> Column:
    horvath = F.when(x < 0, (ADULT + 1) * F.exp(x) - 1).otherwise((ADULT + 1) * x + ADULT)
    return F.when(link == "horvath", horvath).otherwise(x)


def clock_ages(frame: SiteFrame, coefficients: DataFrame, clocks: DataFrame, names: Sequence[str] | None = None, missing: str | DataFrame = "zero") -> DataFrame:
    """station, sample_label, clock, age, n_probes, n_missing.

    frame: probe_id, sample_label, beta. coefficients(clock, probe_id, coef); clocks(clock, intercept, link).
    missing: what stands for a probe that a sample lacks: "zero", "null" (the age is null), or a table
    (probe_id, beta). A name without a clock gives null ages for all samples, as a failing clock does.
    """
    frame.require(["probe_id", "sample_label", "beta"])
    if isinstance(missing, str) and missing not in ("zero", "null"):
        raise BadInput(f"unknown treatment of missing probes {missing!r}")
    wanted = clocks if names is None else clocks.where(F.col("clock").isin(list(names)))
    coefs = coefficients.join(wanted.select("clock"), "clock", "left_semi")
    beta = frame.df.select(col(frame.station).alias("station"), "sample_label", "probe_id", frame.number("beta").alias("beta")).where("beta IS NOT NULL")
    found = beta.join(coefs, "probe_id").groupBy("station", "sample_label", "clock").agg(F.sum(F.col("coef") * F.col("beta")).alias("score"), F.count("*").alias("n_probes"), F.sum("coef").alias("_seen"))
    if isinstance(missing, DataFrame):
        stand = coefs.join(missing.select("probe_id", F.col("beta").alias("stand")), "probe_id", "left").withColumn("part", F.col("coef") * F.coalesce("stand", F.lit(0.0)))
        whole = stand.groupBy("clock").agg(F.count("*").alias("probes"), F.sum("part").alias("stand_all"))
        had = beta.join(stand, "probe_id").groupBy("station", "sample_label", "clock").agg(F.sum("part").alias("stand_seen"))
        found = found.join(had, ["station", "sample_label", "clock"])
    else:
        whole = coefs.groupBy("clock").agg(F.count("*").alias("probes"), F.lit(0.0).alias("stand_all"))
        found = found.withColumn("stand_seen", F.lit(0.0))
    samples = frame.df.select(col(frame.station).alias("station"), "sample_label").distinct()
    every = samples.crossJoin(wanted.join(whole, "clock", "left"))  # a row per sample and clock, as the result has
    out = every.join(found, ["station", "sample_label", "clock"], "left").withColumn("n_probes", F.coalesce("n_probes", F.lit(0)))
    score = F.col("intercept") + F.coalesce("score", F.lit(0.0)) + F.coalesce("stand_all", F.lit(0.0)) - F.coalesce("stand_seen", F.lit(0.0))
    lacking = F.coalesce("probes", F.lit(0)) - F.col("n_probes")
    age = _linked(score, F.col("link"))
    if isinstance(missing, str) and missing == "null":
        age = F.when(lacking == 0, age)
    out = out.select("station", "sample_label", "clock", age.alias("age"), "n_probes", lacking.alias("n_missing"))
    known = {r["clock"] for r in wanted.select("clock").distinct().collect()} if names is not None else set()
    for absent in [n for n in names or () if n not in known]:
        out = out.unionByName(samples.select("station", "sample_label", F.lit(absent).alias("clock"), F.lit(None).cast("double").alias("age"), F.lit(0).cast("long").alias("n_probes"), F.lit(0).cast("long").alias("n_missing")))
    return out


def clock_station_stats(ages: DataFrame) -> DataFrame:
    """station, clock, n, mean, std (of a population), min, max of the known ages."""
    age = F.nanvl("age", F.lit(None))
    return ages.groupBy("station", "clock").agg(F.count(age).alias("n"), F.avg(age).alias("mean"), F.stddev_pop(age).alias("std"), F.min(age).alias("min"), F.max(age).alias("max"))


def clock_global(stats: DataFrame) -> DataFrame:
    """clock, n, n_organizations, weighted_mean, std_pooled, std_pooled_unbiased.

    std_pooled is the root of sum((n - 1) * std^2) / (N - k) with the sites' population deviations; the
    unbiased one takes those of samples, n * std^2. Both are null where N = k.
    """
    s = stats.where("n > 0 AND mean IS NOT NULL")
    left = F.sum("n") - F.count("*")
    var = F.col("std") * F.col("std")
    g = s.groupBy("clock").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_organizations"),
        F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("weighted_mean"),
        F.sqrt(F.try_divide(F.sum((F.col("n") - 1) * var), left)).alias("std_pooled"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * var), left)).alias("std_pooled_unbiased"),
    )
    return g


def clock_means_table(stats: DataFrame, clocks: Sequence[str]) -> DataFrame:
    """organization and a column per clock: means rounded to two places, and the row of weighted means."""
    clocks = list(clocks)
    sites = stats.groupBy(F.concat(F.lit(SITE), F.col("station").cast("string")).alias("organization")).pivot("clock", clocks).agg(F.first("mean"))
    everyone = clock_global(stats).groupBy(F.lit(GLOBAL).alias("organization")).pivot("clock", clocks).agg(F.first("weighted_mean"))
    both = sites.unionByName(everyone)
    return both.select("organization", *[F.round(col(c), 2).alias(c) for c in clocks])


def individual_ages(ages: DataFrame, allowed: bool = False) -> DataFrame:
    """station, clock, ages (in the order of samples); only where disclosure of persons is asked for."""
    if not allowed:
        raise BadInput("individual ages are given only on request")
    return ages.groupBy("station", "clock").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_label", "age"))), lambda s: s["age"]).alias("ages"))


def format_means_table(table: DataFrame) -> str:
    """The table as plain text between rules."""
    rows = table.toPandas()  # a row per site
    if rows.empty:
        return NOTHING
    rows = rows.sort_values("organization", key=lambda s: s.map(lambda x: (x == GLOBAL, x))).set_index("organization")
    return "\n".join(["", RULE, TITLE, RULE, rows.to_string(na_rep="NaN"), RULE, ""])


def to_dict(stats: DataFrame, ages: DataFrame | None = None) -> dict:
    """{organization_breakdown: {station: {clock: {...}}}, global_aggregates: {clock: {...}}[, individual_ages]}."""
    nan = lambda x: math.nan if x is None else x
    out: dict = {"organization_breakdown": {}, "global_aggregates": {}}
    for r in stats.collect():
        out["organization_breakdown"].setdefault(r["station"], {})[r["clock"]] = {"mean": nan(r["mean"]), "std": nan(r["std"]), "min": nan(r["min"]), "max": nan(r["max"]), "N": r["n"]}
    for r in clock_global(stats).collect():
        out["global_aggregates"][r["clock"]] = {"weighted_mean": nan(r["weighted_mean"]), "std_pooled": nan(r["std_pooled"]), "n_total": r["n"], "n_organizations": r["n_organizations"]}
    if ages is not None:
        out["individual_ages"] = {}
        for r in individual_ages(ages, True).collect():
            out["individual_ages"].setdefault(r["station"], {})[r["clock"]] = r["ages"]
    return out


__all__ = ["GLOBAL", "LINKS", "clock_ages", "clock_global", "clock_means_table", "clock_station_stats", "format_means_table", "individual_ages", "to_dict"]
