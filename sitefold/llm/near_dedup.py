"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each document the digest of its full shingle set, BINS one-permutation
   MinHash samples (empty bins filled from others), BANDS band keys, and an odd sketch: every (bin, sample)
   flips one of SKETCH_BITS bits, so that the XOR of two sketches counts the samples that differ.
2. Documents of equal sets form a class; its smallest doc_id stands for it from here on.
3. In every band bucket each document is a candidate for the bucket's smallest one. Sketches screen the
   candidates; the texts of those that pass are compared on their full shingle sets. Components follow.
4. Buckets whose documents still belong to several components are searched in blocks, by sketches. At first
   every document is compared with the likeliest one of another component only, as long as most of these
   turn out to be links; so components join before their pairs are listed. What then passes between different
   components is compared on full sets, in the first band that the two share. No pair that shares a
   band and reaches the screen is lost.

Figures: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^28 = 1 - 4e-7; the
sketch's estimate has a standard error near 0.018 there, and SCREEN lies 4 of them below.

Cases: null texts and texts without words have an empty set and are linked with nothing. Rows that repeat a
doc_id count as one document (of the row with the largest set digest) in candidates; each is returned. A
null doc_id is returned with its n_shingles, a null component_id and kept = true. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, hash_words, mix, read, rows_with, shingles, slices, small_batches, string_bytes, tidy, without
from .components import components

BINS = 1024
BANDS, ROWS = 28, 4
SKETCH_BITS = 2048
SCREEN = 0.73
#: Documents of a bucket that are compared with those of another block at once.
BLOCK = 1024
#: Pairs of sketches that take about as long to compare as handing a pair of blocks to Python, and such units of a task.
PAIRS = 8192
TASK_GROUPS = 1024

_TOP = np.uint64(54)  # 64 - log2(BINS)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN = np.arange(BINS, dtype=np.uint64)
TRIES = 16
_kept: dict[str, np.ndarray] = {}


def _ranks() -> np.ndarray:
    """For every bin a random order of all bins."""
    if "r" not in _kept:
        _kept["r"] = (mix(_BIN[:, None] * np.uint64(BINS) + _BIN + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)
    return _kept["r"]


def _fill(samples: np.ndarray) -> np.ndarray:
    """Empty bins take the sample of the first full bin in an order of their own, the same in every set.

    The order's first TRIES places are drawn one by one, for all sets at once; where those are empty, as in
    small sets, the full bin of least rank is taken.
    """
    full = samples != _EMPTY
    out = samples.copy()
    open_ = ~full & full.any(1, keepdims=True)
    for attempt in range(TRIES):
        donor = (mix(_BIN * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> _TOP).astype(np.int64)
        r, c = np.nonzero(open_)
        ok = full[r, donor[c]]
        r, c = r[ok], c[ok]
        out[r, c] = samples[r, donor[c]]
        open_[r, c] = False
    for i in np.flatnonzero(open_.any(1)):
        at, c = np.flatnonzero(full[i]), np.flatnonzero(open_[i])
        out[i, c] = samples[i, at[_ranks()[np.ix_(c, at)].argmin(1)]]
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and odd sketches (n x SKETCH_BITS / 64) of non-empty shingle sets."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    samples = np.full(n * BINS, _EMPTY)
    np.minimum.at(samples, row * BINS + (flat >> _TOP).astype(np.int64), mix(flat + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1))
    samples = _fill(samples.reshape(n, BINS))
    hashed = mix(samples ^ mix(_BIN + np.uint64(77)))
    bands = np.zeros((n, BANDS), np.uint64)
    step = BINS // (BANDS * ROWS)
    for j in range(ROWS):
        bands = mix(bands * np.uint64(31) + hashed[:, (np.arange(BANDS) * ROWS + j) * step])
    bit = (hashed & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    parity = np.zeros(n * SKETCH_BITS, np.uint8)
    np.add.at(parity, (np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), 1)
    packed = np.packbits((parity & 1).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)
    return bands, packed


def estimate(differing_bits):
    """Similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(np.asarray(differing_bits, float) * 2 / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / 2 * np.log1p(-share) / (2 * BINS)


#: The most differing bits that still pass the screen.
SCREEN_BITS = int(np.max(np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= SCREEN)))


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), bands, sketch of every row; null arrays for empty sets."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            data, offsets = string_bytes(b.column(1))
            for lo, hi in slices(offsets, 1 << 19):
                words, counts = hash_words(data, offsets[lo : hi + 1])
                ends = np.cumsum(counts)
                sets = [np.unique(shingles(words[e - c : e], k)) for c, e in zip(counts, ends, strict=True)]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                sketch = np.zeros((hi - lo, SKETCH_BITS // 64), np.uint64)
                for at in range(0, len(full), 256):
                    part = full[at : at + 256]
                    bands[part], sketch[part] = signatures([sets[i] for i in part])
                d1 = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                d2 = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2)]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (bands, sketch)],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>")


def _differing(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose full shingle sets have 100 * intersection >= percent * union."""
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("u"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    text = rows_with(text, pairs.select("u").union(pairs.select("v")), "u")

    def run(batches):
        for b in batches:
            left, lo = string_bytes(b.column(2))
            right, ro = string_bytes(b.column(3))
            ok, last, kept = np.zeros(len(b), bool), None, None
            v = b.column(1).to_numpy(zero_copy_only=False)
            for i in range(len(b)):
                x = np.unique(shingles(hash_words(left, lo[i : i + 2])[0], k))
                if last != v[i]:
                    last, kept = v[i], np.unique(shingles(hash_words(right, ro[i : i + 2])[0], k))
                both = len(np.intersect1d(x, kept, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(kept) - both)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    one = text.join(pairs, "u").select("u", "v", "text")
    two = one.join(text.select(F.col("u").alias("v"), F.col("text").alias("kept_text")), "v").select("u", "v", "text", "kept_text")
    return two.mapInArrow(tidy(run), "u bigint, v bigint").distinct()


def _search_block(key, left: pd.DataFrame, right: pd.DataFrame, best: bool) -> pd.DataFrame:
    """Pairs of different components whose sketches pass, in the first band they share; or of each document the best."""
    out = []
    if len(left) and len(right):
        band, same_block = key[0], key[2] == key[3]
        a, b = (np.array(x["sketch"].tolist()).view(np.uint64) for x in (left, right))
        ka, kb = (None if best else np.array(x["bands"].tolist()) for x in (left, right))
        ids, jds = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
        least = np.full(len(b), SCREEN_BITS + 1)  # of each right document: bits to its best left one, and which
        which = np.zeros(len(b), np.int64)
        for i in range(len(a)):
            j = np.flatnonzero((ca[i] != cb) & (best or not same_block or ids[i] < jds))
            bits = np.bitwise_count(a[i] ^ b[j]).sum(1)
            j, bits = j[bits <= SCREEN_BITS], bits[bits <= SCREEN_BITS]
            if not len(j):
                continue
            if best:
                k = int(bits.argmin())
                out.append((ids[i], jds[j[k]], int(bits[k])))
                better = bits < least[j]
                least[j[better]], which[j[better]] = bits[better], i
            else:
                first = (ka[i] == kb[j]).argmax(1) == band
                out += [(max(ids[i], x), min(ids[i], x), int(n)) for x, n in zip(jds[j[first]], bits[first], strict=True)]
        if best and not same_block:
            out += [(jds[j], ids[which[j]], int(least[j])) for j in np.flatnonzero(least <= SCREEN_BITS)]
    return pd.DataFrame(out, columns=["u", "v", "bits"], dtype="int64")


def search_buckets(placed: DataFrame, buckets: DataFrame, best: bool) -> DataFrame | None:
    """Pairs (u, v) of documents that share a bucket, but no component, and whose sketches pass; None without any.

    placed(doc_id, component, bands, sketch). Buckets of one component are done with, and so is everything a
    bucket's lead has been compared with. One of n documents is cut into ceil(n / BLOCK) blocks; a task
    compares two blocks, so that a large bucket spreads over many tasks. With best, each document gives
    only the pair of its likeliest partner.
    """
    spread = placed.select("doc_id", "component", F.posexplode("bands").alias("band", "value")).join(buckets.where("n > 2").select("band", "value", "lead"), ["band", "value"]).where("doc_id != lead")
    sizes = spread.groupBy("band", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    sizes = cut(sizes.select("band", "value", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    cost = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2 + F.col("n") * F.col("n") / PAIRS)).first()[0]
    if cost is None:
        return None
    tasks = max(math.ceil(cost / TASK_GROUPS), placed.sparkSession.sparkContext.defaultParallelism)
    sizes = sizes.drop("n")
    m = spread.join(sizes, ["band", "value"]).select("band", "value", "blocks", "doc_id")
    # the bands serve to find the first that two documents share
    bands = F.lit(None).cast("array<int>") if best else F.transform("bands", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    m = m.join(placed.withColumn("bands", bands), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    columns = ["band", "value", "i", "j", "doc_id", "component", "bands", "sketch"]
    left = m.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(columns)
    right = m.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block")))).select([F.col(c).alias(c) for c in columns])
    keys = ["band", "value", "i", "j"]
    search = lambda key, a, b: _search_block(key, a, b, best)
    left, right = (x.repartition(tasks, *keys) for x in (left, right))  # by work: bytes say little of it
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "u bigint, v bigint, bits bigint")
    if best:
        found = found.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("b")).select(F.greatest("u", "b.v").alias("u"), F.least("u", "b.v").alias("v"))
    found = cut(found.select("u", "v").distinct())
    return None if found.isEmpty() else found


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links are Jaccard >= percent / 100 of k-word shingles."""
    small_batches(docs.sparkSession)
    sig = cut(sketch_documents(docs, k))
    known = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    # written without classes of one, so that the join of a class of very many can be split
    classes = cut(known.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").cast("long").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = F.col("doc_id").cast("long")
    member = cut(known.join(classes, ["n_shingles", "d1", "d2"], "left").select(own.alias("doc_id"), F.coalesce("rep", own).alias("rep")).distinct())
    chosen = member.where("doc_id = rep").select("doc_id")
    reps = cut(known.withColumn("doc_id", F.col("doc_id").cast("long")).join(chosen, "doc_id").groupBy("doc_id").agg(F.max(F.struct("d1", "bands", "sketch")).alias("s")).select("doc_id", "s.bands", "s.sketch"))

    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "value"))
    buckets = cut(rows.groupBy("band", "value").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    pairs = rows.join(buckets, ["band", "value"]).where("doc_id != lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")).distinct()
    sk = reps.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a"))
    near = pairs.join(sk, "u").join(sk.toDF("v", "b"), "v").where(_differing("a", "b") <= SCREEN_BITS).select("u", "v")
    links = cut(verify(docs, cut(near), k, percent))
    found = components(links)

    best = True
    while True:
        placed = cut(reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        more = search_buckets(placed, buckets, best)
        discard(placed)
        if more is None:
            break
        new = cut(verify(docs, more, k, percent))
        links = cut(links.unionByName(new))
        found = components(links)
        if not best:
            break
        best = 2 * new.count() > more.count()

    comp = found.withColumnRenamed("node", "rep")
    of = member.join(comp, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    base = sig.select("doc_id", "n_shingles")
    out = base.join(of, base.doc_id.eqNullSafe(of.doc_id), "left").select(base.doc_id, "n_shingles", F.when(F.col("n_shingles") > 0, of.component_id).otherwise(base.doc_id).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; rows without a doc_id stay."""
    return without(docs, cut(near_dedup(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct()), "doc_id")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), k=4)


ORACLE = {
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(doc_id, reach) AS (
  SELECT u, v FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u
), c AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(c.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
}
