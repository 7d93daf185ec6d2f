"""Fisher's exact test on a 2 x 2 table counted over all sites."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame, col
from ..functions.dist import fisher_exact
from ..policy import Policy


def distinct_categories(frame: SiteFrame, group: str, outcome: str) -> DataFrame:
    """column, value (as text): the categories of both columns over all sites."""
    _check(frame, group, outcome)
    each = F.array(*[F.struct(F.lit(c).alias("column"), frame.value(c).cast("string").alias("value")) for c in (group, outcome)])
    return frame.df.select(F.explode(each).alias("s")).select("s.column", "s.value").where("value IS NOT NULL").distinct()


def _check(frame: SiteFrame, group: str, outcome: str) -> None:
    frame.require([group, outcome])
    if group == outcome:
        raise BadInput("group and outcome must be different columns")


def _cells(frame: SiteFrame, group: str, outcome: str) -> DataFrame:
    """station, group, outcome, n, with a row where one of both is null."""
    keys = [col(frame.station).alias("station"), frame.value(group).alias("group"), frame.value(outcome).alias("outcome")]
    return frame.df.groupBy(*keys).agg(F.count("*").alias("n"))


def contingency_station(frame: SiteFrame, group: str, outcome: str) -> DataFrame:
    """station, group, outcome, n, with a row for every pair of categories that some site knows.

    The categories (of rows that have both) come back to the driver first.
    """
    _check(frame, group, outcome)
    cells = _cells(frame, group, outcome)
    both = F.col("group").isNotNull() & F.col("outcome").isNotNull()
    pair = F.struct("group", "outcome")
    known = cells.where(both).agg(F.sort_array(F.collect_set("group")).alias("g"), F.sort_array(F.collect_set("outcome")).alias("o")).first()
    kinds = [cells.schema[c].dataType for c in ("group", "outcome")]
    pairs = [F.struct(F.lit(g).cast(kinds[0]).alias("group"), F.lit(o).cast(kinds[1]).alias("outcome")) for g in known["g"] for o in known["o"]]
    if not pairs:
        return cells.where(F.lit(False))
    counts = F.map_from_entries(F.collect_list(F.when(both, F.struct(pair.alias("key"), F.col("n").alias("value")))))
    per = cells.groupBy("station").agg(counts.alias("counts"))
    each = per.select("station", "counts", F.explode(F.array(*pairs)).alias("c"))
    return each.select("station", "c.group", "c.outcome", F.coalesce(F.col("counts")[F.col("c")], F.lit(0).cast("long")).alias("n"))


def contingency(frame: SiteFrame, group: str, outcome: str) -> DataFrame:
    """group, outcome, n over all sites; pairs that never occur have no row."""
    _check(frame, group, outcome)
    return frame.complete([group, outcome]).df.groupBy(frame.value(group).alias("group"), frame.value(outcome).alias("outcome")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class FisherResult:
    oddsratio: float
    p_value: float
    contingency_table: list[list[int]]
    group_values: list
    outcome_values: list

    def table_json(self) -> str:
        """The table as JSON in split form: columns (outcomes), index (groups) and data."""
        return json.dumps({"columns": self.outcome_values, "index": self.group_values, "data": self.contingency_table})


def table_from_json(text: str) -> tuple[list, list, list[list[int]]]:
    """Groups, outcomes and counts of a table in split form."""
    found = json.loads(text)
    return found["index"], found["columns"], found["data"]


def fisher(frame: SiteFrame, group: str, outcome: str, stations: Sequence | None = None, alternative: str = "two-sided", policy: Policy | None = None) -> FisherResult:
    """Groups and outcomes in ascending order; BadInput unless there are two of each.

    One aggregate per site and pair of categories serves the sites' rule and the table; categories count even
    where the other column is missing.
    """
    policy = policy or Policy()
    frame = frame.include(stations)
    _check(frame, group, outcome)
    if alternative not in ("two-sided", "less", "greater"):
        raise BadInput(f"unknown alternative {alternative!r}")
    cells = _cells(frame, group, outcome)
    most = 10  # a table that passes has nine kinds of cells at most, nulls included
    pairs = cells.groupBy("group", "outcome").agg(F.sum("n").alias("n")).limit(most).select(F.lit(None).cast("string").alias("station"), "group", "outcome", "n")
    few = cells.groupBy("station").agg(F.sum("n").alias("n")).where(F.col("n") <= policy.fisher_min_rows)
    few = few.select(F.coalesce(F.col("station").cast("string"), F.lit("")).alias("station"), *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in ("group", "outcome")], "n")
    rows = pairs.unionByName(few).collect()
    below = sorted(r["station"] for r in rows if r["station"] is not None)
    if below:
        raise BadInput(f"sites with {policy.fisher_min_rows} rows or fewer: {below}")
    n = {(r["group"], r["outcome"]): r["n"] for r in rows}
    values = [sorted({k[i] for k in n if k[i] is not None}) for i in (0, 1)]
    if len(n) == most or len(values[0]) != 2 or len(values[1]) != 2:
        raise BadInput(f"two groups and two outcomes are needed, found {values[0][:5]} and {values[1][:5]}")
    table = [[n.get((g, o), 0) for o in values[1]] for g in values[0]]
    ratio, p = fisher_exact(*table[0], *table[1], alternative)
    return FisherResult(ratio, p, table, *values)
