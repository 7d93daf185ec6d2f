"""Shared plumbing of the llm operators: written intermediates and hashing of UTF-8 text in numpy."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of code points other than these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder if the session runs in one process; on a cluster a folder of the
    default file system, which must not be a machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return f"{tempfile.gettempdir()}/sitefold-shared"
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).getHomeDirectory().toString()
    if home.startswith("file:"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{home}/.sitefold-shared"


def cut(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the shared folder and return a scan of it.

    Cuts lineage like checkpoint(), but evaluates df once and keeps the file columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitefold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the bitmap that rows_with broadcasts: 8 MB, however many ids there are.
FILTER_BITS = 1 << 26
_BUCKET_BITS = 8 * 4096  # of one of Spark's bitmaps


def rows_with(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without most rows whose key is not in ids(key); only a filter before a join on key.

    Ids set bits of a bitmap of fixed size, which is broadcast in blocks; rows whose bit is not set go, so that
    their texts are not shuffled. The more ids there are the more other rows pass too; none of ids is lost.
    """
    return _marked(df, ids, key).where("found_bit").drop("found_bit")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key (null included) is in ids(key).

    Only rows whose bit of the bitmap is set are shuffled to be joined; all others stay where they are.
    """
    mark, k = unused("found_bit", df.columns), unused("key", df.columns)
    marked = _marked(df, ids, key, mark)
    unsure = marked.where(mark).drop(mark)
    gone = ids.select(F.col(key).alias(k)).distinct()
    return marked.where(~F.col(mark)).drop(mark).unionByName(unsure.join(gone, unsure[key].eqNullSafe(gone[k]), "left_anti"))


def _marked(df: DataFrame, ids: DataFrame, key: str, mark: str = "found_bit") -> DataFrame:
    """df and whether the bit of its key is set."""

    def bit(x):
        return F.pmod(F.xxhash64(x.cast("string")), F.lit(FILTER_BITS))

    block, bits, place = (unused(x, df.columns) for x in ("bit_block", "bit_map", "bit_place"))
    # a bit of every block, so that the bitmap has one size whatever ids there are
    every = ids.sparkSession.range(FILTER_BITS // _BUCKET_BITS).select((F.col("id") * _BUCKET_BITS).alias("bit"))
    at = ids.select(bit(F.col(key)).alias("bit")).unionByName(every)
    n, within = (F.col("bit") / _BUCKET_BITS).cast("int"), (F.col("bit") % _BUCKET_BITS).cast("int")
    maps = at.groupBy(n.alias(block + "_")).agg(F.bitmap_construct_agg(within).alias(bits))
    own = bit(df[key])
    near = df.withColumns({block: (own / _BUCKET_BITS).cast("int"), place: (own % _BUCKET_BITS).cast("int")})
    is_set = F.expr(f"coalesce((shiftright(cast(conv(hex(substring({bits}, cast({place} / 8 AS int) + 1, 1)), 16, 10) AS int), {place} % 8) & 1) = 1, false)")
    joined = near.join(F.broadcast(maps), F.col(block) == F.col(block + "_"), "left")
    return joined.select(*[f"`{c}`" for c in df.columns], is_set.alias(mark))


#: Bytes that few() broadcasts at most.
FEW_BYTES = 8 << 20


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, texts included, take at most FEW_BYTES; larger ones are joined by shuffle."""
    size = F.lit(0)
    for c, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16 if kind == "string" else F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= FEW_BYTES else df


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on the session exchanges Arrow batches of at most about `most` bytes with Python workers.

    A batch takes several times its size outside the heap, in each task and on both sides; the default is 64 MB.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None) or "").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by cut() that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sitefold-" in name:
            _delete(spark, name)
            _written[:] = [w for w in _written if not name.endswith(w[1].rsplit("/", 1)[1])]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """name, longer by underscores until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(col, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(folds)


# ---------------------------------------------------------------- text in numpy

_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Tells runs of different lengths apart.
_LENGTH = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(1 << 20, 1 << (n - 1).bit_length()) + 1
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
        _powers["n"] = size - 1
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give free memory back to the system: a Python worker lives on from stage to stage, and else keeps the most it ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; elsewhere there is none
    if trim is not None:
        trim(0)


def tidy(run):
    """run(batches), at whose end the worker gives free memory back: it may wait, or work for other stages, for long."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    release()  # what the batch before took
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of documents of about `most` bytes together; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive documents, and how many words each document has.

    The hash is a polynomial of the word's bytes: differences of one running sum, divided by the power
    at the word's start, so that no Python code runs per word.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    buf = data[begin:end]
    at = offsets - begin
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    inside = ~_IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * up[: len(buf)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    first = np.searchsorted(starts, at)
    return words, np.diff(first)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one document; with fewer words, of the whole run; none without words."""
    n = len(words)
    if n == 0:
        return words
    j = min(k, n)
    total = np.zeros(n - j + 1, np.uint64)
    for i in range(j):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - j + 1 + i]
    return mix(total ^ _LENGTH[j])
