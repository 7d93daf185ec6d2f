"""Tables of sites, and matrices of betas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..frame import SiteFrame


def read_csv(spark: SparkSession, uri: str, schema: T.StructType | str | None = None, trim: bool = False) -> DataFrame:
    """A CSV file with a header. Without a schema types are inferred, which reads the file twice.

    Spaces around values stay, as part of texts, unless trim is set; blank cells are null.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(uri)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None, **options: str) -> DataFrame:
    """A table, or a query in parentheses, of a database; options as of Spark's source, such as partitionColumn."""
    properties = {k: v for k, v in (("user", user), ("password", password)) if v is not None}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **properties, **options).load()


def read_sites(spark: SparkSession, uris: Mapping[object, str], station: str = "station", **options) -> SiteFrame:
    """One frame from a CSV file per site."""
    return SiteFrame.from_sites({name: read_csv(spark, uri, **options) for name, uri in uris.items()}, station)


def read_matrix(spark: SparkSession, uri: str) -> DataFrame:
    """A wide matrix of betas; an empty frame without columns if it can't be read."""
    try:
        return read_csv(spark, uri)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([]))


def matrix_info(spark: SparkSession, uris: Mapping[str, str]) -> dict[str, dict]:
    """{name: {path, cpg_sites, samples, exists}}: rows, and columns but the first."""
    out = {}
    for name, uri in uris.items():
        m = read_matrix(spark, uri)
        there = bool(m.columns)
        out[name] = {"path": uri, "cpg_sites": m.count() if there else 0, "samples": len(m.columns) - 1 if there else 0, "exists": there}
    return out
