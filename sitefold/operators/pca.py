"""Principal components from counts, sums and products that sites add up.

Up to SQL_FEATURES features the products are sums of one aggregate; beyond, each task multiplies its Arrow
batches and gives one matrix, so that the plan doesn't grow with the square of the features. Only the d x d
matrix reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame, col

SQL_FEATURES = 30


@dataclass(frozen=True)
class PcaResult:
    """components: features x k, each column's largest entry positive; ratios are of the sum of all eigenvalues."""

    columns: list[str]
    n_total: int
    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    centered: bool
    covariance: np.ndarray

    def to_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}


def _features(frame: SiteFrame, features: Sequence[str] | None) -> list[str]:
    names = frame.require(list(features)) if features is not None else frame.numeric_columns()
    if not names:
        raise BadInput("no features")
    wrong = [c for c in names if not frame.is_numeric(c)]
    if wrong:
        raise BadInput(f"not numeric: {', '.join(wrong)}")
    return names


def gram_station(frame: SiteFrame, features: Sequence[str] | None = None) -> DataFrame:
    """station, n, sums (array of d), products (array of d arrays of d) over complete rows."""
    names = _features(frame, features)
    frame = frame.complete(names)
    d = len(names)
    x = [frame.number(c) for c in names]
    station = col(frame.station).alias("station")
    if d <= SQL_FEATURES:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        wide = frame.df.groupBy(station).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
        rows = [F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for j in range(d)]) for i in range(d)]
        return wide.select("station", "n", F.array(*[F.col(f"s{i}") for i in range(d)]).alias("sums"), F.array(*rows).alias("products"))
    return _gram_by_batch(frame.df.select(station, *[v.alias(f"x{i}") for i, v in enumerate(x)]), d)


def gram_of_vectors(df: DataFrame, station: str, vector: str, d: int) -> DataFrame:
    """gram_station of an array column of d numbers; rows whose array is null, of another length or with nulls are left out."""
    v = col(vector)
    whole = v.isNotNull() & (F.size(v) == d) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")))
    return _gram_by_batch(df.where(whole).select(col(station).alias("station"), *[v[i].cast("double").alias(f"x{i}") for i in range(d)]), d)


def _gram_by_batch(df: DataFrame, d: int) -> DataFrame:
    def run(batches):
        sums: dict = {}
        kind = pa.null()
        for b in batches:
            kind = b.column(0).type
            if not len(b):
                continue
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)], axis=1).astype(float)
            codes = b.column(0).dictionary_encode()
            at = np.where(np.asarray(codes.indices.is_null()), -1, codes.indices.fill_null(0).to_numpy(zero_copy_only=False))
            for k in np.unique(at):
                name = codes.dictionary[int(k)].as_py() if k >= 0 else None
                rows = x[at == k]
                n, s, p = sums.get(name, (0, 0.0, 0.0))
                sums[name] = (n + len(rows), s + rows.sum(0), p + rows.T @ rows)
        if sums:
            numbers = pa.list_(pa.float64())
            n, s, p = zip(*sums.values(), strict=True)
            columns = [pa.array(list(sums), kind), pa.array(n, pa.int64()), pa.array([v.tolist() for v in s], numbers), pa.array([v.ravel().tolist() for v in p], numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["station", "n", "sums", "products"])

    out = f"station {dict(df.dtypes)['station']}, n bigint, sums array<double>, products array<double>"
    parts = df.mapInArrow(run, out)
    long = parts.select("station", "n", F.posexplode(F.concat("sums", "products")).alias("i", "x"))
    added = long.groupBy("station", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    flat = added.groupBy("station").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    rows = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.slice("v", i * d + 1, d))
    return flat.select("station", "n", F.slice("v", 1, d).alias("sums"), rows.alias("products"))


def merge_grams(grams: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and products over all sites; a site of another shape is left out."""
    n, sums, products = 0, np.zeros(d), np.zeros((d, d))
    for r in grams.collect():  # a row per site
        s, p = np.array(r["sums"], float), np.array(r["products"], float)
        if s.shape == (d,) and p.shape == (d, d):
            n, sums, products = n + r["n"], sums + s, products + p
    return n, sums, products


def covariance_matrix(n: int, sums: np.ndarray, products: np.ndarray, center: bool = True, compat: str | None = None) -> np.ndarray:
    """Of a sample; without centring the products themselves over n - 1. As written, one feature has covariance 0."""
    if compat == "as_written" and len(sums) == 1:
        return np.zeros((1, 1))
    scatter = products - np.outer(sums, sums) / n if center else products
    return scatter / max(n - 1, 1)


def decompose(cov: np.ndarray, n_components: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components (columns), their eigenvalues in descending order, and shares of all eigenvalues' sum."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    k = len(values) if n_components is None else max(1, min(int(n_components), len(values)))
    total = values.sum()
    return (vectors * sign)[:, :k], values[:k], values[:k] / total if total > 0 else np.zeros(k)


def pca(frame: SiteFrame, features: Sequence[str] | None = None, n_components: int | None = None, center: bool = True, compat: str | None = None) -> PcaResult:
    names = _features(frame, features)
    return pca_of(gram_station(frame, names), names, n_components, center, compat)


def pca_of(grams: DataFrame, names: list[str], n_components: int | None = None, center: bool = True, compat: str | None = None) -> PcaResult:
    n, sums, products = merge_grams(grams, len(names))
    if not n:
        raise BadInput("no site has a complete row")
    cov = covariance_matrix(n, sums, products, center, compat)
    components, values, ratios = decompose(cov, n_components)
    return PcaResult(list(names), n, sums / n, components, values, ratios, center, cov)


def covariance(frame: SiteFrame, features: Sequence[str] | None = None, center: bool = True) -> DataFrame:
    """row, col, value of the covariance matrix, computed without leaving the executors.

    Pairs are aggregates of Spark's own covar_samp, which merges central moments and so keeps its digits.
    """
    names = _features(frame, features)
    frame = frame.complete(names)
    x = [frame.number(c) for c in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = [(F.covar_samp(x[i], x[j]) if center else F.sum(x[i] * x[j]) / F.greatest(F.count("*") - 1, F.lit(1))).alias(f"c{i}_{j}") for i, j in pairs]
    wide = frame.df.agg(*one)
    cells = [F.struct(F.lit(names[i]).alias("row"), F.lit(names[j]).alias("col"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("value")) for i in range(len(names)) for j in range(len(names))]
    return wide.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
