"""A table split by rows across sites: a DataFrame and the column that names each row's site."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BadInput


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and parentheses included."""
    return F.col(quoted(name))


@dataclass(frozen=True)
class SiteFrame:
    df: DataFrame
    station: str = "station"

    def __post_init__(self):
        if self.station not in self.df.columns:
            raise BadInput(f"no column {self.station!r}")

    @classmethod
    def from_sites(cls, sites: Mapping[object, DataFrame], station: str = "station") -> SiteFrame:
        """One frame from the tables of several sites, which must have the same columns."""
        if not sites:
            raise BadInput("no sites")
        frames = [df.withColumn(station, F.lit(name)) for name, df in sites.items()]
        names = {tuple(sorted(f.columns)) for f in frames}
        if len(names) > 1:
            raise BadInput("the sites' columns differ")
        return cls(reduce(DataFrame.unionByName, frames), station)

    def include(self, sites: Iterable[object] | None) -> SiteFrame:
        """Only these sites; all if none are named."""
        sites = list(sites) if sites is not None else []
        return SiteFrame(self.df.where(col(self.station).isin(sites)), self.station) if sites else self

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.station]

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_numeric(self, name: str, booleans: bool = False) -> bool:
        kind = self.type_of(name)
        return isinstance(kind, T.NumericType) or booleans and isinstance(kind, T.BooleanType)

    def numeric_columns(self, among: Sequence[str] | None = None) -> list[str]:
        return [c for c in (self.columns if among is None else among) if self.is_numeric(c)]

    def require(self, columns: Sequence[str]) -> list[str]:
        """columns, if all are there."""
        absent = [c for c in columns if c not in self.columns]
        if absent:
            raise BadInput(f"no such columns: {', '.join(absent)}")
        return list(columns)

    def value(self, name: str) -> Column:
        """A column in which NaN is null, as every statistic here skips missing values."""
        return F.nanvl(col(name), F.lit(None)) if isinstance(self.type_of(name), (T.FloatType, T.DoubleType)) else col(name)

    def number(self, name: str) -> Column:
        """A column as double, NaN as null; text that is no number raises when it is read."""
        x = self.value(name).cast("double")
        return F.nanvl(x, F.lit(None)) if not isinstance(self.type_of(name), T.BooleanType) else x

    def complete(self, columns: Sequence[str]) -> SiteFrame:
        """Rows that have a value in all of columns (list-wise deletion)."""
        keep = reduce(lambda a, c: a & self.value(c).isNotNull(), columns, F.lit(True))
        return SiteFrame(self.df.where(keep), self.station)
