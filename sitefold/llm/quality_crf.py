"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are its own measures and those of its two neighbours; a transition
score links adjacent lines. Forward-backward marginals of "good", weighted by line length and averaged,
are calibrated to the probability that a document's label is 1.

The field is fitted on the driver on a bounded sample: at most TRAIN_PER_CLASS labelled documents of each
class (those of smallest hash) of at most TRAIN_LINES lines, and longer ones only where those are too few; their labels go to all their lines. The
calibration weighs the classes by their counts over all labels. Scoring reads every whole text.

Cases: null and empty texts, and texts of white space only, score EMPTY_SCORE. Very long texts cost their length,
by lines and in one task each. Null labels and labels other
than 0 and 1 are not learned from; without labels of one class the score is 1 - EMPTY_SCORE (only good
known, or none) or EMPTY_SCORE (only bad known). Repeated rows get equal scores, a null doc_id is not held
out and never learned from, extra columns are ignored or passed on, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, bucket_of, hash_words, mix, read, slices, small_batches, string_bytes, tidy

TRAIN_PER_CLASS = 1500
TRAIN_LINES = 500
THRESHOLD = 0.3
EMPTY_SCORE = 0.0
FOLDS = 5

_MEASURES = ("upper", "lower", "digit", "symbol", "pipe", "bang", "stop", "comma", "space")
_CLASS = np.zeros((len(_MEASURES), 256), np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&<>", b"|", b"!", b".", b",", (32, 9))):
    _CLASS[_i, list(_chars)] = 1
#: Own measures of a line, then the line before, then the line after; without a neighbour zeros.
N_OWN = len(_MEASURES) + 9


@dataclass(frozen=True)
class Model:
    """Weights of "good" against "bad", transition scores [from, to], means and scales, and the calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float
    constant: float | None = None


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines of consecutive documents, their weights (bytes other than white space), and lines per document."""
    begin = int(offsets[0])
    buf = data[begin : int(offsets[-1])]
    at = offsets - begin
    newline = np.flatnonzero(buf == 10)
    # a line runs from after a newline, or the document's start, to the next newline or the document's end
    starts = np.concatenate((at[:-1], newline + 1))
    ends = np.concatenate((newline, at[1:]))
    owner = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, newline, "right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    owner_end = np.concatenate((np.searchsorted(at, newline, "right") - 1, np.arange(len(at) - 1)))
    ends = ends[np.lexsort((ends, owner_end))]
    lines = np.bincount(owner, minlength=len(at) - 1)

    size = np.maximum(ends - starts, 1).astype(float)
    columns = []
    for table in _CLASS:
        total = np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))
        columns.append((total[ends] - total[starts]) / size)
    solid = np.concatenate(([0], np.cumsum(~_IS_SPACE[buf], dtype=np.int64)))
    weight = solid[ends] - solid[starts]

    bounds = np.concatenate((starts, [len(buf)])) if len(starts) else np.zeros(1, np.int64)
    words, n_words = hash_words(buf, bounds.astype(np.int64))
    line_of = np.repeat(np.arange(len(starts)), n_words)
    count = np.maximum(n_words, 1).astype(float)
    order = np.lexsort((words, line_of))
    w, l = words[order], line_of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (l[1:] != l[:-1])
    distinct = np.bincount(l[new], minlength=len(starts)) / count
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    stutter = np.bincount(line_of, again, minlength=len(starts)) / count

    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(1) * (np.arange(len(words), dtype=np.uint64) - np.repeat(np.cumsum(n_words) - n_words, n_words).astype(np.uint64))), dtype=np.uint64)))
    last = np.cumsum(n_words)
    line_hash = total[last] - total[last - n_words]
    order = np.lexsort((np.arange(len(starts)), line_hash, owner))
    repeated = np.zeros(len(starts))
    repeated[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]) & (n_words[order[1:]] > 0)

    letters = columns[0] + columns[1]
    own = np.stack([*columns, np.log1p(size) / 8, columns[0] / np.maximum(letters, 1e-3), weight / count / 10, distinct, stutter, repeated, (n_words == 0) * 1.0, (n_words < 4) * 1.0, (columns[3] + columns[4] > 0.02) * 1.0], axis=1)
    return own, weight, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's measures, those of the line before and of the line after in the same document, and 1."""
    owner = np.repeat(np.arange(len(lines)), lines)
    same = (owner[1:] == owner[:-1])[:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    return np.concatenate((own, before, after, np.ones((len(own), 1))), axis=1)


def marginals(scores: np.ndarray, lines: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transitions of each kind, by scaled forward-backward.

    scores: of "good" against "bad" per line; documents step together, longest first.
    """
    start = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    lengths = lines[order]
    step = np.exp(transitions - transitions.max())
    emit = np.stack((1 / (1 + np.exp(np.clip(scores, -30, 30))), 1 / (1 + np.exp(-np.clip(scores, -30, 30)))), axis=1)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest + 1)]  # documents of more than t lines
    forward, backward = np.zeros_like(emit), np.ones_like(emit)
    now = None
    for t in range(longest):
        rows = start[order[: alive[t]]] + t
        now = emit[rows] if t == 0 else (now[: alive[t]] @ step) * emit[rows]
        now = now / now.sum(1, keepdims=True)
        forward[rows] = now
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = start[order[: alive[t + 1]]] + t
        ahead = emit[rows + 1] * backward[rows + 1]
        back = ahead @ step.T
        both = forward[rows][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        backward[rows] = back / back.sum(1, keepdims=True)
    p = forward * backward
    return p[:, 1] / p.sum(1), pairs


def fit(own: np.ndarray, weight: np.ndarray, lines: np.ndarray, quality: np.ndarray, share: float, rounds: int = 250) -> Model:
    """Maximum likelihood with a small ridge by Adam steps; share: of label 1 among all labels."""
    mean, scale = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours((own - mean) / scale, lines)
    y = np.repeat(quality, lines).astype(float)
    ends = np.cumsum(lines)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    a = y[np.flatnonzero(inner)].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (a, y[np.flatnonzero(inner) + 1].astype(int)), 1)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    n = len(lines)
    for i in range(1, rounds + 1):
        p, pairs = marginals(x @ w, lines, trans)
        for k, (value, grad) in enumerate(((w, x.T @ (p - y) / n + 2e-3 * w), (trans, (pairs - seen) / n + 2e-2 * trans))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value -= 0.08 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    raw = aggregate(marginals(x @ w, lines, trans)[0], weight, lines)
    z = _logit(raw)
    sample = np.where(quality == 1, share / max(quality.mean(), 1e-9), (1 - share) / max(1 - quality.mean(), 1e-9))
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps of a ridge logistic regression in one variable
        q = 1 / (1 + np.exp(-(slope * z + shift)))
        g = np.array([(sample * (q - quality) * z).sum() + 1e-2 * (slope - 1), (sample * (q - quality)).sum() + 1e-2 * shift])
        r = sample * q * (1 - q) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(d[0], -1, 1), shift - np.clip(d[1], -1, 1)
    return Model(w, trans, mean, scale, float(max(slope, 0.05)), float(shift))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def aggregate(good: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; NaN for a document without a word."""
    owner = np.repeat(np.arange(len(lines)), lines)
    total = np.bincount(owner, weight, minlength=len(lines))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(owner, weight * good, minlength=len(lines)) / total


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Scores of a column of texts."""
    data, offsets = string_bytes(column)
    out = np.full(len(offsets) - 1, EMPTY_SCORE)
    for lo, hi in slices(offsets):
        own, weight, lines = line_features(data, offsets[lo : hi + 1])
        if model.constant is not None:
            raw = np.where(np.bincount(np.repeat(np.arange(hi - lo), lines), weight, minlength=hi - lo) > 0, model.constant, np.nan)
        else:
            x = with_neighbours((own - model.mean) / model.scale, lines)
            good, _ = marginals(x @ model.weights, lines, model.transitions)
            raw = 1 / (1 + np.exp(-(model.slope * _logit(aggregate(good, weight, lines)) + model.shift)))
        out[lo:hi] = np.where(np.isnan(raw), EMPTY_SCORE, raw)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod FOLDS is not 0."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), FOLDS) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(*[np.zeros(1)] * 4, 1.0, 0.0, EMPTY_SCORE if list(counts) == [0] else 1 - EMPTY_SCORE)
    # documents with something to measure, in order of hash; longer ones only fill up what the others leave
    text = F.col("text").cast("string")
    measured = docs.where(text.rlike(r"[^\x20\x09-\x0D]")).groupBy("doc_id").agg(F.max(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))
    known = known.distinct().join(measured, "doc_id").withColumn("long", F.col("lines") > TRAIN_LINES)
    chosen = None
    for q in (0, 1):
        order = ["long", F.xxhash64("doc_id"), "doc_id"]
        part = known.where(F.col("quality") == q).orderBy(*order).limit(TRAIN_PER_CLASS)
        so_far = Window.partitionBy("quality").orderBy(*order)
        part = part.withColumn("no", F.row_number().over(so_far)).withColumn("total", F.sum("lines").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
        part = part.where((F.col("no") == 1) | (F.col("total") <= TRAIN_PER_CLASS * TRAIN_LINES)).select("doc_id", "quality")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def run(batches):
        for b in batches:
            data, offsets = string_bytes(b.column(1))
            rows = []
            for i in range(len(b)):
                own, weight, lines = line_features(data, offsets[i : i + 2])
                if weight.sum():
                    rows.append((b.column(0)[i].as_py(), own.astype(np.float32).tobytes(), weight.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["quality", "own", "weight"])

    # at most 2 * TRAIN_PER_CLASS ids are broadcast, and as many documents' measures come back
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.max("text").alias("text")).select("quality", "text")  # one row of a repeated doc_id
    got = sample.mapInArrow(tidy(run), "quality int, own binary, weight binary").collect()
    got = sorted(((r["quality"], bytes(r["own"]), bytes(r["weight"])) for r in got), key=lambda r: r[1:])[: 2 * TRAIN_PER_CLASS]
    quality = np.array([q for q, _, _ in got])
    if len(set(quality.tolist())) < 2:
        return Model(*[np.zeros(1)] * 4, 1.0, 0.0, EMPTY_SCORE if set(quality.tolist()) == {0} else 1 - EMPTY_SCORE)
    lines = np.array([len(w) // 4 for _, _, w in got])
    own = np.frombuffer(b"".join(o for _, o, _ in got), np.float32).reshape(-1, N_OWN).astype(float)
    weight = np.frombuffer(b"".join(w for _, _, w in got), np.float32).astype(float)
    return fit(own, weight, lines, quality, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(model, b.column(1)), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, score double")
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_texts(model, b.column(at)) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
