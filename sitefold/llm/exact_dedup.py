"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the polynomial of its normalised UTF-8 bytes modulo two primes, with the byte
length. Chunks hash independently (one matrix product for all chunks of a text) and combine by shifting:
H(ab) = H(a) * B^len(b) + H(b). Texts of more than HUGE bytes are dealt out in sections, which hash in tasks of
their own and combine by their numbers. Texts of equal fingerprint are then compared with the one that stays,
section by section, so that a collision can never drop a document; whole texts are never shuffled.

Cases: null and empty texts are equal to each other. Every row comes back, repeated ones too: rows that repeat
a doc_id and a text count in group_size and have one verdict, so that several rows stay where the one to stay
repeats; keep_first() keeps one of them. A null doc_id sorts below every other, very long texts are split as
above, extra columns are ignored, clashing names included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, rows_with, slices, small_batches, string_bytes, tidy, unused, without

#: Two primes below 2^31: a chunk of 4096 bytes sums below 2^53, so float64 products are exact.
PRIMES = (2147483647, 2147483629)
BASE = 1000003
CHUNK = 4096
#: Bytes above which a text is hashed in sections, and bytes of a section.
HUGE, SECTION = 4 << 20, 1 << 20
#: Bytes of text compared at once.
PIECE = 1 << 16
#: Members compared against one copy of a group's text.
FAN = 1024
#: Repeated rows that one step brings back.
REPEATS = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chunk_powers(primes: tuple[int, ...]) -> np.ndarray:
    table = np.zeros((CHUNK, len(primes)))
    for j, p in enumerate(primes):
        x = 1
        for i in range(CHUNK):
            table[CHUNK - 1 - i, j] = x
            x = x * BASE % p
    return table


def combine(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """The (hash, length) of two adjacent pieces of text."""
    return (left[0] * pow(BASE, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(raw: np.ndarray, powers: np.ndarray, primes: tuple[int, ...] = PRIMES) -> list[int]:
    """Of bytes; leading zeros don't change the polynomial, so the first chunk is filled up in front."""
    n = -(-len(raw) // CHUNK)
    padded = np.zeros(n * CHUNK, np.float64)
    padded[n * CHUNK - len(raw) :] = raw
    hashes = padded.reshape(n, CHUNK) @ powers
    out = []
    for j, p in enumerate(primes):
        whole = (0, 0)
        for x in hashes[:, j]:
            whole = combine(whole, (int(x), CHUNK), p)
        out.append(whole[0])
    return out


def _normal_texts(batch, at: int, most: int = 1 << 20):
    """Row number and normalised bytes of every text of a batch."""
    data, offsets = string_bytes(batch.column(at))
    for lo, hi in slices(offsets, most):
        start = offsets[lo]
        norm = _LOWER[data[start : offsets[hi]]]
        for i in range(lo, hi):
            yield i, norm[offsets[i] - start : offsets[i + 1] - start]


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE, section: int = SECTION) -> DataFrame:
    """doc_id, fp (long), n_bytes (long), text_sha256, n_rows: how many rows have these."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        powers = _chunk_powers(primes)
        for b in batches:
            rows: list[tuple] = []
            for i, x in _normal_texts(b, 1):
                sha, long = hashlib.sha256(x).hexdigest(), len(x) > huge
                h = [0, 0] if long else fingerprint(x, powers, primes)
                rows.append((i, None if long else h[0] << 31 | h[1], len(x), sha, None, None))
                for no, lo in enumerate(range(0, len(x), section) if long else ()):
                    rows.append((i, None, len(x), sha, no, x[lo : lo + section].tobytes()))
                    if len(rows) % 8 == 0:
                        yield batch(b, rows)
                        rows = []
            if rows:
                yield batch(b, rows)

    def batch(b, rows):
        at, *columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "fp", "n_bytes", "text_sha256", "no", "section"])

    def hash_sections(batches):
        powers = _chunk_powers(primes)
        for b in batches:
            raw = [np.frombuffer(x, np.uint8) for x in b.column(3).to_pylist()]
            h = [fingerprint(x, powers, primes) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.int64()) for c in ([x[0] for x in h], [x[1] for x in h], [len(x) for x in raw]))], ["text_sha256", "n_bytes", "no", "h0", "h1", "size"])

    def join_sections(batches):
        for b in batches:
            fps = []
            for parts in b.column(2).to_pylist():
                whole = [(0, 0)] * 2
                for part in parts:
                    whole = [combine(w, (part[f"h{j}"], part["size"]), p) for j, (w, p) in enumerate(zip(whole, primes, strict=True))]
                fps.append(whole[0][0] << 31 | whole[1][0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["s", "n", "joined"])

    hashed = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, fp bigint, n_bytes bigint, text_sha256 string, no int, section binary"))
    columns = ["doc_id", "fp", "n_bytes", "text_sha256"]
    whole = hashed.where("no IS NULL").groupBy(*columns).agg(F.count("*").alias("n_rows"))
    sections = hashed.where("no IS NOT NULL").select("text_sha256", "n_bytes", "no", "section").repartition("text_sha256", "no")
    parts = sections.mapInArrow(tidy(hash_sections), "text_sha256 string, n_bytes bigint, no int, h0 bigint, h1 bigint, size bigint").distinct()
    parts = parts.groupBy("text_sha256", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("no", "h0", "h1", "size"))).alias("parts"))
    joined = parts.mapInArrow(join_sections, "s string, n bigint, joined bigint")
    # few texts are that long, and only those lack a fingerprint
    long = whole.where("fp IS NULL").join(joined, (F.col("text_sha256") == F.col("s")) & (F.col("n_bytes") == F.col("n")))
    return whole.where("fp IS NOT NULL").unionByName(long.select("doc_id", F.col("joined").alias("fp"), "n_bytes", "text_sha256", "n_rows"))


def text_pieces(docs: DataFrame) -> DataFrame:
    """d, tag (hash of the normalised text), n_bytes, no, piece of every row: its normalised bytes in pieces, numbered from 0; an empty text has one."""
    id_type = dict(docs.dtypes)["d"]

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for i, x in _normal_texts(b, 1):
                tag = xxhash.xxh3_64_intdigest(x) - (1 << 63)
                for no, lo in enumerate(range(0, max(len(x), 1), PIECE)):
                    rows.append((i, tag, len(x), no, x[lo : lo + PIECE].tobytes()))
                    size += len(rows[-1][-1])
                    if size > 1 << 21:
                        yield batch(b, rows)
                        rows, size = [], 0
            if rows:
                yield batch(b, rows)

    def batch(b, rows):
        at, *columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["d", "tag", "n_bytes", "no", "piece"])

    return docs.mapInArrow(tidy(run), f"d {id_type}, tag bigint, n_bytes bigint, no int, piece binary")


def compare(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members(doc_id, class, keep_id, fan) -> class, doc_id, same: whether some text of doc_id equals one of keep_id."""
    text = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text"))
    pieces = text_pieces(rows_with(text, members.select(F.col("doc_id").alias("d")).union(members.select("keep_id")), "d"))
    sides = members.select("class", F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("fan")).alias("salt"))
    keeps = members.groupBy("class", F.col("keep_id").alias("i"), "fan").agg(F.lit(1).alias("one"))
    # rows that share a doc_id may differ in text: their hash and length tell them apart
    own = pieces.join(sides, pieces.d.eqNullSafe(sides.i)).select("class", "salt", "no", "n_bytes", F.col("d").alias("doc_id"), "tag", "piece")
    kept = pieces.join(keeps, pieces.d.eqNullSafe(keeps.i)).select("class", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), "no", "n_bytes", F.col("tag").alias("kept_tag"), F.col("piece").alias("kept_piece"))
    both = own.join(kept, ["class", "salt", "no", "n_bytes"], "left")
    equal = F.coalesce(F.col("piece") == F.col("kept_piece"), F.lit(False))
    each = both.groupBy("class", "doc_id", "tag", "kept_tag").agg(F.bool_and(equal).alias("same"))
    return each.groupBy("class", "doc_id").agg(F.bool_or("same").alias("same"))


def exact_dedup(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE, section: int = SECTION) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The document with the largest doc_id of equal texts (A-Z lower-cased, null as empty) stays.
    """
    out = verdicts(docs, primes, huge, section)
    # rows that repeat come back in two steps, so that no array grows with them
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / REPEATS))))
    left = F.least(F.col("n_rows") - F.col("part") * REPEATS, F.lit(REPEATS))
    out = out.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def verdicts(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE, section: int = SECTION) -> DataFrame:
    """exact_dedup() of distinct pairs of doc_id and text, and n_rows: how many rows repeat one."""
    seen = cut(fingerprints(docs, primes, huge, section))
    todo, settled = seen, None
    while True:
        # groups of one document need no row here; written, so that a hot fingerprint's join can be split
        groups = cut(todo.groupBy("fp", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_docs"), F.sum("n_rows").alias("group_size")).where("n_docs > 1"))
        joined = todo.join(groups, ["fp", "n_bytes"], "left")
        joined = joined.withColumn("keep_id", F.when(F.col("n_docs").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", "n_rows"))
        suspects = todo.join(groups, ["fp", "n_bytes"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        suspects = cut(suspects.select("doc_id", "keep_id", F.struct("fp", "n_bytes").alias("class"), F.ceil(F.col("n_docs") / FAN).alias("fan")))
        differ = cut(compare(docs, suspects).where(~F.col("same")).select(F.col("doc_id").alias("d"), F.col("class.fp").alias("f"), F.col("class.n_bytes").alias("b")))
        if differ.isEmpty():
            break
        # a collision: those that differ from the one that stays are groups of their own, found anew
        apart = joined["doc_id"].eqNullSafe(differ["d"]) & (joined["fp"] == differ["f"]) & (joined["n_bytes"] == differ["b"])
        todo = cut(joined.join(differ, apart, "left_semi").select(*seen.columns))
        gone = todo.groupBy("fp", "n_bytes").agg(F.sum("n_rows").alias("gone"))
        done = joined.join(differ, apart, "left_anti").join(gone, ["fp", "n_bytes"], "left").withColumn("group_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).drop("gone")
        settled = cut(done if settled is None else settled.unionByName(done))
    out = joined if settled is None else settled.unionByName(joined)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_rows")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id, and of repeated rows one.

    Rows go by doc_id. Only where several rows share one are they told apart by their text's hash, and repeated
    ones, which may differ in other columns, by these as JSON.
    """
    found = cut(verdicts(docs).select("doc_id", "kept", "text_sha256", "n_rows"))
    several = cut(found.groupBy("doc_id").agg(F.sum("n_rows").alias("n"), F.bool_or("kept").alias("any")).where("n > 1 OR NOT any"))
    single = without(docs, several.select("doc_id"), "doc_id")
    several = several.where("any")
    if several.isEmpty():
        return single
    stays = found.where("kept").select(F.col("doc_id").alias("d"), "text_sha256")
    r, sha = unused("repeated", docs.columns), unused("sha", docs.columns)
    many = docs.join(several.select(F.col("doc_id").alias(r)), F.col("doc_id").eqNullSafe(F.col(r)), "left_semi")
    many = many.withColumn(sha, F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = many.groupBy("doc_id", sha).agg(F.max_by(row, F.to_json(row)).alias("row"))
    one = one.join(stays, one["doc_id"].eqNullSafe(stays["d"]) & (one[sha] == stays["text_sha256"]), "left_semi")
    return single.unionByName(one.select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = {
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
}
