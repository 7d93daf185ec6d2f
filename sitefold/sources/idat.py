"""Array scans: which samples a folder holds, and what the scanner's binary files hold.

A scan file starts with "IDAT", a version and a count of fields; each field has a code and a place. The
codes read here are public knowledge of the format's third version.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput
from ..functions.scalar import sample_label

#: Codes of fields: how many probes, their addresses, deviations, mean intensities and bead counts.
PROBES, ADDRESS, DEVIATION, MEAN, BEADS = 1000, 102, 103, 104, 107
_SCHEMA = "path string, address bigint, mean int, sd int, n_beads int"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def find_idat_files(spark: SparkSession, directory: str) -> DataFrame:
    """path of every file below directory whose suffix is .idat in any case; only listings are read."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[iI][dD][aA][tT]").load(directory)
    return files.select("path")


def sample_manifest(spark: SparkSession, idat_dir: str | None = None, uri: str | None = None, fallback: str | None = None) -> DataFrame:
    """sample_label, idat_dir: distinct samples of idat_dir, or of uri; of fallback only where neither is there.

    A file stands for its folder. A folder without scans has no samples.
    """
    for place in (idat_dir or uri, fallback):
        folder = place.rsplit("/", 1)[0] if place and place.lower().endswith(".idat") else place
        if folder and exists(spark, folder):
            labels = find_idat_files(spark, folder).select(sample_label(F.col("path")).alias("sample_label")).distinct()
            return labels.orderBy("sample_label").withColumn("idat_dir", F.lit(folder))
    return spark.createDataFrame([], "sample_label string, idat_dir string")


def parse_idat(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Addresses, means, deviations and bead counts of one file."""
    if raw[:4] != b"IDAT":
        raise BadInput("not an IDAT file")
    version, n_fields = struct.unpack_from("<qi", raw, 4)
    if version != 3:
        raise BadInput(f"IDAT version {version} is not supported")
    at = dict(struct.unpack_from("<Hq", raw, 16 + 10 * i) for i in range(n_fields))
    if not {PROBES, ADDRESS, DEVIATION, MEAN, BEADS} <= set(at):
        raise BadInput("the IDAT file lacks a field")
    n = struct.unpack_from("<i", raw, at[PROBES])[0]
    read = lambda code, kind: np.frombuffer(raw, kind, n, at[code])
    return read(ADDRESS, "<i4"), read(MEAN, "<u2"), read(DEVIATION, "<u2"), read(BEADS, "u1")


def write_idat(address: np.ndarray, mean: np.ndarray, sd: np.ndarray, beads: np.ndarray) -> bytes:
    """A file with these fields, as parse_idat reads it; for tests."""
    bodies = [(PROBES, struct.pack("<i", len(address))), (ADDRESS, address.astype("<i4").tobytes()), (DEVIATION, sd.astype("<u2").tobytes()), (MEAN, mean.astype("<u2").tobytes()), (BEADS, beads.astype("u1").tobytes())]
    place, table, data = 16 + 10 * len(bodies), b"", b""
    for code, body in bodies:
        table += struct.pack("<Hq", code, place + len(data))
        data += body
    return b"IDAT" + struct.pack("<qi", 3, len(bodies)) + table + data


def read_idat(spark: SparkSession, directory: str, min_beads: int = 1) -> DataFrame:
    """sample_label, channel (Grn or Red), address, mean, sd, n_beads of probes with min_beads beads or more.

    A file is one task's row, however many probes it has; BadInput if there are no files.
    """
    if find_idat_files(spark, directory).isEmpty():
        raise BadInput(f"no IDAT files in {directory}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[iI][dD][aA][tT]").load(directory).select("path", "content")

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                address, mean, sd, beads = parse_idat(raw)
                ok = beads >= min_beads
                columns = [pa.array([path] * int(ok.sum())), pa.array(address[ok].astype(np.int64)), *(pa.array(x[ok].astype(np.int32)) for x in (mean, sd, beads))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "address", "mean", "sd", "n_beads"])

    channel = F.when(F.lower("path").contains("_grn"), "Grn").when(F.lower("path").contains("_red"), "Red")
    return files.mapInArrow(run, _SCHEMA).select(sample_label(F.col("path")).alias("sample_label"), channel.alias("channel"), "address", "mean", "sd", "n_beads")


def intensities(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    """read_idat ⨝ manifest(address, channel, probe_id, allele) -> sample_label, probe_id, channel, allele, intensity."""
    return scans.join(manifest, ["address", "channel"]).select("sample_label", "probe_id", "channel", "allele", F.col("mean").cast("double").alias("intensity"))
