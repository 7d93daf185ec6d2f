"""Exact quantiles per site in memory that doesn't grow with the values.

A quantile lies between two neighbouring values of known ranks. Where a site has few values, one aggregate
holds them. Otherwise every rank's value is enclosed in an open interval, which each scan narrows: it counts
what lies below and inside, and cuts what is inside at GRID approximate steps, of which a few stay. Counts
are exact, so an interval that misses its rank is seen and widened. What lies inside comes down by a
factor near GRID / 8 with each scan, until the values left fit into an array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import SiteFrame, col

#: Values of a column and site that one aggregate may hold at once.
DIRECT = 1 << 20
#: Values in an interval that come into one array.
INSIDE = 1 << 16
GRID = 250


@dataclass
class _Rank:
    """The k-th smallest value (from 0): inside the open interval, or found."""

    k: int
    low: float | None = None
    high: float | None = None
    slack: int = 2
    found: float | None = None
    skip: int = 0
    ready: bool = False
    outer: tuple = (None, None)

    def seen(self, below: int, upto_low: int, inside: int, upto_high: int, steps: list | None, most: int) -> None:
        """Narrow by a scan's counts: values under low, up to low, inside, up to high; steps cut the inside."""
        if self.k < below or self.k >= upto_high:
            self.low, self.high, self.slack = *self.outer, 2 * self.slack
        elif self.k < upto_low:
            self.found = self.low
        elif self.k >= upto_low + inside:
            self.found = self.high
        elif inside <= most:
            self.skip, self.ready = self.k - upto_low, True
        else:
            self.outer = self.low, self.high
            at = (self.k - upto_low) / inside * GRID
            i, j = math.floor(at) - self.slack, math.ceil(at) + self.slack
            if i >= 0:
                self.low = steps[i]
            if j <= GRID:
                self.high = steps[j]


def station_quantiles(frame: SiteFrame, columns: Sequence[str], at: Sequence[float], per_station: bool = True, values: int | None = None) -> DataFrame:
    """[station,] q0, q1, ...: of each column an array of its quantiles at, with linear interpolation.

    A column without values has nulls. values: the most that a column of a site can have, if known.
    """
    numbers = [frame.number(c) for c in columns]
    keys = [col(frame.station).alias("station")] if per_station else []
    if values is None or not per_station or values > DIRECT:
        counts = frame.df.groupBy(*keys).agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(numbers)]).collect()
        values = max((r[f"n{i}"] for r in counts for i in range(len(columns))), default=0)
    if values <= DIRECT:
        return frame.df.groupBy(*keys).agg(*[F.percentile(x, F.array(*map(F.lit, at))).alias(f"q{i}") for i, x in enumerate(numbers)])
    return _narrowed(frame, numbers, at, per_station, counts)


def _narrowed(frame: SiteFrame, numbers: list[Column], at: Sequence[float], per_station: bool, counts: list) -> DataFrame:
    spark = frame.df.sparkSession
    kind = frame.type_of(frame.station).simpleString() if per_station else "int"
    station = col(frame.station) if per_station else F.lit(0)
    ranks: dict = {}  # of each site a list: of each column and quantile the ranks below and above
    for r in counts:
        for i in range(len(numbers)):
            for q in at:
                place = q * max(r[f"n{i}"] - 1, 0)
                ranks.setdefault(r["station"] if per_station else 0, []).extend(_Rank(k) if r[f"n{i}"] else _Rank(k, found=math.nan) for k in (math.floor(place), math.ceil(place)))
    each = 2 * len(at)
    cells = [(j, numbers[j // each]) for j in range(each * len(numbers))]

    grid = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")

    def scan(wanted, picks):
        """Aggregates over every site's rows beside its intervals; ranks with the same intervals share them."""
        first: dict = {}
        shared = {}
        for j, x in cells:
            if any(wanted(of[j]) for of in ranks.values()):
                key = (j // each, tuple((of[j].low, of[j].high) for of in ranks.values()))
                shared[j] = first.setdefault(key, j)
        rows = [(site, [x.low for x in of], [x.high for x in of], [any(wanted(of[i]) for i, at_ in shared.items() if at_ == j) for j, _ in cells]) for site, of in ranks.items()]
        named = spark.createDataFrame(rows, f"_site {kind}, _low array<double>, _high array<double>, _wanted array<boolean>")
        both = frame.df.join(F.broadcast(named), station.eqNullSafe(F.col("_site")))  # a row per site
        aggregates = [a.alias(f"{name}{j}") for j, x in cells if j in first.values() for name, a in picks(j, x).items()]
        for r in both.groupBy("_site").agg(*aggregates).collect():
            for j, i in shared.items():
                if wanted(ranks[r["_site"]][j]):
                    yield ranks[r["_site"]][j], r, i

    def inside(j, x):
        low, high = F.col("_low")[j], F.col("_high")[j]
        return F.col("_wanted")[j] & (low.isNull() | (x > low)) & (high.isNull() | (x < high))

    def narrow(j, x):
        low, high = F.col("_low")[j], F.col("_high")[j]
        steps = F.percentile_approx(F.when(inside(j, x), x), grid, F.lit(10 * GRID))
        return {"below": F.count_if(x < low), "low": F.count_if(x <= low), "inside": F.count_if(inside(j, x)), "high": F.count_if(x.isNotNull() & (high.isNull() | (x <= high))), "steps": steps}

    def take(j, x):
        return {"values": F.sort_array(F.collect_list(F.when(inside(j, x), x)))}

    def is_open(x):
        return x.found is None and not x.ready

    def is_ready(x):
        return x.found is None and x.ready

    while any(is_open(x) for of in ranks.values() for x in of):
        for x, r, i in scan(is_open, narrow):
            x.seen(r[f"below{i}"], r[f"low{i}"], r[f"inside{i}"], r[f"high{i}"], r[f"steps{i}"], INSIDE)
    if any(is_ready(x) for of in ranks.values() for x in of):
        for x, r, i in scan(is_ready, take):
            x.found = r[f"values{i}"][x.skip]
    out = []
    for r in counts:
        of = ranks[r["station"] if per_station else 0]
        row = [r["station"]] if per_station else []
        for i in range(len(numbers)):
            n, got = r[f"n{i}"], []
            for m, q in enumerate(at):
                place = q * (n - 1)
                low, high = (x.found for x in of[i * each + 2 * m : i * each + 2 * m + 2])
                part = place - math.floor(place)
                got.append(low if part == 0 or low == high else (1 - part) * low + part * high)
            row.append(got if n else None)
        out.append(tuple(row))
    fields = ([f"station {kind}"] if per_station else []) + [f"q{i} array<double>" for i in range(len(numbers))]
    return spark.createDataFrame(out, ", ".join(fields))
