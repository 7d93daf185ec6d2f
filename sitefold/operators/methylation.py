"""DNA methylation: reshaping, Beta and M values, masks, signal correction, and means over sites.

The canonical table is long: [station,] probe_id, sample_label, beta, m_value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput
from ..frame import SiteFrame, col
from ..functions.scalar import m_value
from ..sources import idat

KEYS = ("probe_id", "sample_label")
# Names of columns in tables of this kind.
#: Columns of a wide table that describe probes rather than hold samples.
ANNOTATIONS = ("type", "channel", "probe_type")
#: Masks of an annotation table, in the order they are applied.
MASKS = ("quality", "control", "non_cpg", "snp", "xy")


def wide_to_long(wide: DataFrame, value: str = "beta", probe: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """[keep,] probe_id, sample_label, value: a row per probe and sample. probe: the first column unless named."""
    probe = probe or wide.columns[0]
    samples = [c for c in wide.columns if c != probe and c not in ANNOTATIONS and c not in keep]
    if not samples:
        raise BadInput("no sample columns")
    ids = [*[col(c) for c in keep], col(probe).cast("string").alias("probe_id")]
    return wide.select(*ids, *[col(c).cast("double").alias(c) for c in samples]).unpivot([*map(col, keep), "probe_id"], [col(c) for c in samples], "sample_label", value)


def long_to_wide(long: DataFrame, value: str = "beta", samples: Sequence[str] | None = None) -> DataFrame:
    """probe_id and a column per sample; naming the samples saves a pass over the data."""
    grouped = long.groupBy("probe_id")
    return (grouped.pivot("sample_label", list(samples)) if samples else grouped.pivot("sample_label")).agg(F.first(value))


def with_m_values(betas: DataFrame) -> DataFrame:
    """Adds m_value of the same row's beta, which needs no join."""
    return betas.withColumn("m_value", m_value(F.col("beta")))


def join_beta_m(betas: DataFrame, ms: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join one to one, as one aggregate on the keys; reading the result raises if a key repeats on either side."""
    keys = list(keys)
    sides = [[c for c in df.columns if c not in keys] for df in (betas, ms)]
    names = ("_beta", "_m")
    rows = [df.select(*map(col, keys), F.struct(F.lit(True).alias("_there"), *[col(c) for c in own]).alias(name)) for df, own, name in zip((betas, ms), sides, names, strict=True)]
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).groupBy(*keys).agg(*[F.count(x).alias(f"n{x}") for x in names], *[F.any_value(x, True).alias(x) for x in names])
    again = F.raise_error(F.concat(F.lit("repeated: "), F.to_json(F.struct(*map(col, keys)))))
    both = both.where("n_beta > 0").where(F.when((F.col("n_beta") > 1) | (F.col("n_m") > 1), again.cast("boolean")).otherwise(True))
    return both.select(*map(col, keys), *[F.col("_beta")[c].alias(c) for c in sides[0]], *[F.col("_m")[c].alias(c) for c in sides[1]])


def mask_probes(values: DataFrame, annotation: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """values without the probes that annotation(probe_id, and a flag per mask) flags by any of masks."""
    flagged = F.lit(False)
    for m in masks:
        if m in annotation.columns:
            flagged = flagged | F.coalesce(col(m).cast("boolean"), F.lit(False))
    return values.join(annotation.where(flagged).select("probe_id").distinct(), "probe_id", "left_anti")


def intensities_to_betas(intensities: DataFrame, offset: float = 100.0) -> DataFrame:
    """(…, meth, unmeth) -> with beta = meth / (meth + unmeth + offset) and m_value; negative intensities count as 0, a missing one gives none."""
    meth, unmeth = (F.when(F.col(c).isNotNull(), F.greatest(c, F.lit(0))) for c in ("meth", "unmeth"))
    return with_m_values(intensities.withColumn("beta", F.try_divide(meth.cast("double"), meth + unmeth + offset))).drop("meth", "unmeth")


def probe_means_station(frame: SiteFrame) -> DataFrame:
    """station, probe_id, beta_mean, m_mean, n_samples: means of a site's known values, and its samples.

    Samples are those of the whole site, even for a probe that some of them lack.
    """
    for c in ("probe_id", "sample_label", "beta", "m_value"):
        frame.require([c])
    station = col(frame.station).alias("station")
    means = frame.df.where("probe_id IS NOT NULL").groupBy(station, "probe_id").agg(F.avg(frame.number("beta")).alias("beta_mean"), F.avg(frame.number("m_value")).alias("m_mean"), F.count_if(frame.number("beta").isNotNull()).alias("n_values"))
    samples = frame.df.groupBy(station).agg(F.count_distinct("sample_label").alias("n_samples"))
    return means.join(samples, means["station"].eqNullSafe(samples["station"])).select(means["station"], "probe_id", "beta_mean", "m_mean", "n_samples", "n_values")


def probe_means_global(stations: DataFrame, weight: str = "samples") -> DataFrame:
    """probe_id, beta_mean_global, m_mean_global, n_samples_total from probe_means_station.

    Sites weigh by their samples; weight="per_probe" by the samples that have the probe.
    """
    if weight not in ("samples", "per_probe"):
        raise BadInput(f"unknown weight {weight!r}")
    w = F.col("n_samples" if weight == "samples" else "n_values")
    return stations.groupBy("probe_id").agg(
        F.try_divide(F.sum(F.col("beta_mean") * w), F.sum(w)).alias("beta_mean_global"), F.try_divide(F.sum(F.col("m_mean") * w), F.sum(w)).alias("m_mean_global"), F.sum(w).alias("n_samples_total")
    )


# ---------------------------------------------------------------- signal correction; one group is one sample's channel


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can be grouped together with one it comes from."""
    return df.select([col(c).alias(c) for c in df.columns])


def detection_p_values(signals: DataFrame, background: DataFrame, keys: Sequence[str] = ("sample_label", "channel")) -> DataFrame:
    """signals(keys, probe_id, intensity) -> with p_value: share of background(keys, intensity) at least as bright."""

    def one(key, s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        seen = np.sort(b["intensity"].dropna().to_numpy(float))
        below = np.searchsorted(seen, s["intensity"].to_numpy(float), "left")
        p = 1 - below / len(seen) if len(seen) else np.full(len(s), np.nan)
        return s.assign(p_value=np.where(s["intensity"].isna(), np.nan, p))

    keys = list(keys)
    return signals.groupBy(*keys).cogroup(_apart(background).groupBy(*keys)).applyInPandas(one, signals.drop("p_value").schema.add("p_value", "double"))


def mask_undetected(signals: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(sample_label, probe_id, p_value; a row per channel) -> sample_label, probe_id whose least p-value is at most threshold."""
    return signals.groupBy("sample_label", "probe_id").agg(F.min("p_value").alias("p_value")).where((F.col("p_value") <= threshold) & ~F.isnan("p_value"))


def normal_exponential(x: np.ndarray, mu: float, sigma: float, alpha: float) -> np.ndarray:
    """Expected signal of x = signal + background: background normal, signal exponential of mean alpha."""
    sigma, alpha = max(sigma, 1e-6), max(alpha, 1e-6)
    center = x - mu - sigma * sigma / alpha
    z = center / sigma
    v = np.maximum(z, -30)
    tail = 0.5 * np.array([math.erfc(t) for t in (-v / math.sqrt(2)).tolist()])
    near = center + sigma * np.exp(-0.5 * v * v) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-300)
    return np.maximum(np.where(z > -30, near, -sigma / np.minimum(z, -1)), 1e-6)  # far out, the tail's first term


def noob(signals: DataFrame, background: DataFrame, keys: Sequence[str] = ("sample_label", "channel"), offset: float = 15.0) -> DataFrame:
    """signals(keys, probe_id, intensity) with the background's part taken out (normal-exponential model).

    The background's centre and spread are its median and scaled median deviation.
    """

    def one(key, s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = s["intensity"].to_numpy(float)
        seen = b["intensity"].dropna().to_numpy(float)
        if len(seen) and len(x):
            mu = float(np.median(seen))
            sigma = 1.4826 * float(np.median(np.abs(seen - mu)))
            alpha = max(float(np.nanmean(x)) - mu, 10.0)
            x = normal_exponential(x, mu, sigma, alpha) + offset
        return s.assign(intensity=x)

    keys = list(keys)
    return signals.groupBy(*keys).cogroup(_apart(background).groupBy(*keys)).applyInPandas(one, signals.schema)


def correct_dye_bias(signals: DataFrame, sample: str = "sample_label") -> DataFrame:
    """(sample, channel, probe_id, intensity): both channels get the mean of their quantiles, sample by sample."""

    def one(s: pd.DataFrame) -> pd.DataFrame:
        s = s.reset_index(drop=True)
        parts = {c: s.index[(s["channel"] == c) & s["intensity"].notna()] for c in s["channel"].unique()}
        parts = {c: i for c, i in parts.items() if len(i)}
        if len(parts) == 2:
            ordered = {c: np.sort(s.loc[i, "intensity"].to_numpy(float)) for c, i in parts.items()}
            grid = np.linspace(0, 1, max(map(len, ordered.values())))
            middle = np.mean([np.quantile(v, grid) for v in ordered.values()], axis=0)
            values = s["intensity"].to_numpy(float).copy()
            for c, i in parts.items():
                v = values[i]
                below, upto = np.searchsorted(ordered[c], v, "left"), np.searchsorted(ordered[c], v, "right")
                values[i] = np.interp((below + upto - 1) / 2 / max(len(v) - 1, 1), grid, middle)
            s["intensity"] = values
        return s

    return signals.groupBy(sample).applyInPandas(one, signals.schema)


def preprocess(signals: DataFrame, background: DataFrame, annotation: DataFrame | None = None, threshold: float = 0.05, offset: float = 100.0) -> DataFrame:
    """signals(sample_label, probe_id, channel, allele: meth or unmeth, intensity), background(sample_label, channel,
    intensity) -> probe_id, sample_label, beta, m_value: detection, masks, dye bias, background, Beta, M."""
    need = {"sample_label", "probe_id", "channel", "allele", "intensity"}
    if not need <= set(signals.columns):
        raise BadInput(f"signals lack {sorted(need - set(signals.columns))}")
    signals = signals.select("sample_label", "probe_id", "channel", "allele", F.col("intensity").cast("double").alias("intensity"))
    background = background.select("sample_label", "channel", F.col("intensity").cast("double").alias("intensity"))
    seen = mask_undetected(detection_p_values(signals, background), threshold).select("sample_label", "probe_id")
    values = noob(correct_dye_bias(signals), background)
    values = values.join(seen, ["sample_label", "probe_id"], "left_semi")
    if annotation is not None:
        values = mask_probes(values, annotation)
    both = values.groupBy("probe_id", "sample_label").agg(F.max(F.when(F.col("allele") == "meth", F.col("intensity"))).alias("meth"), F.max(F.when(F.col("allele") == "unmeth", F.col("intensity"))).alias("unmeth"))
    return intensities_to_betas(both.where("meth IS NOT NULL AND unmeth IS NOT NULL"), offset).where("beta IS NOT NULL")


def out_of_band(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """sample_label, channel, intensity: what probes of one channel show in the other one, which is background.

    manifest(address, channel, ...); addresses without a channel, which both channels read, have none.
    """
    own = manifest.where("channel IS NOT NULL").select("address", F.col("channel").alias("own")).distinct()
    return scans.join(own, "address").where("channel != own").select("sample_label", "channel", F.col("mean").cast("double").alias("intensity"))


def preprocess_folder(spark: SparkSession, manifest: DataFrame, idat_dir: str | None = None, samples: DataFrame | None = None, fallback: str | None = None, annotation: DataFrame | None = None, min_beads: int = 1, threshold: float = 0.05) -> DataFrame:
    """From a folder of scans to probe_id, sample_label, beta, m_value.

    The folder is idat_dir, or the first idat_dir of samples, or fallback where that is missing; BadInput if
    there is none or it holds no scans. manifest(address, channel, probe_id, allele).
    """
    folder = idat_dir
    if folder is None and samples is not None and "idat_dir" in samples.columns:
        first = samples.where("idat_dir IS NOT NULL").select("idat_dir").first()
        folder = first["idat_dir"] if first else None
    if folder is None or not idat.exists(spark, folder):
        folder = fallback
    if folder is None:
        raise BadInput("no folder of scans")
    scans = idat.read_idat(spark, folder, min_beads)
    return preprocess(idat.intensities(scans, manifest), out_of_band(scans, manifest), annotation, threshold)
