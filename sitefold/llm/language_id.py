"""Language ID: script ranges narrow the candidates, Viterbi labels spans, spans vote.

A word's score under a language is the mean log-probability of its character 1- to 3-grams (with word ends),
smoothed, from counts of that language's training texts; languages never seen in the word's script are out.
Viterbi over the words of a document finds the best labels with a penalty for every switch. A document's
language is that of most letters; its score is that language's share of the letters, times how far the words
so labelled favour it over the runner-up.

Viterbi is skipped where one_language() shows that no switch can pay.

Training counts the n-grams of whole texts: of about TRAIN_PER_LANG documents with a letter of each language
(those of smallest hash, to the bin of hashes that reaches that number), so that no language is left out, however
many there are and however long its texts. The model has MODEL_CELLS numbers at most: 2^TABLE_BITS slots for
n-grams a language, half as many each time that the languages would exceed it. Every text is predicted whole;
n-grams of a very long one are looked up piece by piece.

Cases: a null text, an empty one or one without a letter is `und` with score 0, as is everything if nothing
could be learned; combining marks belong to the word they follow and are no letters. A null lang is not learned
from. Repeated rows get equal predictions; a null doc_id is neither held out nor learned from; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, mix, read, small_batches

FOLDS, HELD_OUT = 4, 2
TRAIN_PER_LANG = 600
#: Bins of a document's chance, for each halving of it.
CHANCE_BINS = 16
TABLE_BITS = 17
MODEL_CELLS = 1 << 25
PENALTY = 6.0
UNKNOWN = "und"
#: Characters handled at once.
SLICE = 1 << 19

#: (first, last, script) code point ranges; scripts are numbered from 1, 0 is any other letter.
SCRIPT_RANGES = (
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x077F, 6), (0xFB50, 0xFEFC, 6),  # Arabic
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0B80, 0x0BFF, 9),  # Tamil
    (0x0E00, 0x0E7F, 10),  # Thai
    (0x10A0, 0x10FF, 11),  # Georgian
    (0x3040, 0x30FF, 12),  # Kana
    (0x3400, 0x9FFF, 13), (0x20000, 0x2FFFF, 13),  # Han
    (0xAC00, 0xD7AF, 14), (0x1100, 0x11FF, 14),  # Hangul
)
N_SCRIPTS = 15

#: Keeps n-grams of different lengths apart.
_ORDER_SALT = mix(np.arange(1, 4, dtype=np.uint64))
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Script + 1 of every code point that is a letter, MARK of a combining mark, else 0."""
    if "t" not in _tables:
        import unicodedata

        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                t[c] = 1 if kind == "L" else MARK
        for first, last, script in SCRIPT_RANGES:
            part = t[first : last + 1]
            part[part == 1] = script + 1
        _tables["t"] = t
    return _tables["t"]


MARK = 255


@dataclass(frozen=True)
class Model:
    """langs; log-probabilities by hashed n-gram (rows) and language; allowed[script, language]."""

    langs: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram slots of all words of texts, the word of each slot, and per word its document, letters and script."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[np.minimum(code, 0x10FFFF)]
    is_mark = kind == MARK
    # a mark belongs to a word if what it follows, marks aside, is a letter
    last = np.maximum.accumulate(np.where(is_mark, 0, np.arange(len(kind)))) if is_mark.any() else None
    is_letter = kind > 0 if last is None else (kind[last] > 0) & (kind[last] != MARK)
    starts = np.flatnonzero(is_letter & ~np.concatenate(([False], is_letter[:-1])))
    ends = np.flatnonzero(is_letter & ~np.concatenate((is_letter[1:], [False]))) + 1
    size = ends - starts
    if last is not None:
        marks = np.concatenate(([0], np.cumsum(is_mark)))
        size = size - (marks[ends] - marks[starts])
    doc_ends = np.cumsum([len(t) + 1 for t in low])
    doc = np.searchsorted(doc_ends, starts, "right")
    script = kind[starts].astype(np.int64) - 1
    # letters and the place after each word; anything that isn't a letter counts as the word's edge
    c = np.where(is_letter, code, 0).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), c[:-1]))
    before2 = np.concatenate((np.zeros(2, np.uint64), c[:-2]))[: len(c)]
    before2[before == 0] = 0
    after_word = np.zeros(len(c), bool)
    after_word[np.minimum(ends, len(c) - 1)] = True
    used = np.flatnonzero(is_letter | after_word)
    c, before, before2 = c[used], before[used], before2[used]
    two = c | before << np.uint64(21)
    three = two | before2 << np.uint64(42)
    shift = np.uint64(64 - TABLE_BITS)
    slots = np.stack([mix(x ^ salt) >> shift for salt, x in zip(_ORDER_SALT, (c, two, three), strict=True)], axis=1).astype(np.int64)
    word = np.searchsorted(starts, used, "right") - 1
    return slots, word, doc, size, script


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of a sequence: scores (n x languages) summed, minus penalty for every switch."""
    n, k = scores.shape
    if k <= 8:
        return np.array(_viterbi_few(scores.tolist(), penalty))
    back = np.zeros((n, k), np.int16)
    best = scores[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        moved = best < switch
        back[t] = np.where(moved, top, stay)
        best = np.where(moved, switch, best) + scores[t]
    labels = np.zeros(n, np.int64)
    labels[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def _viterbi_few(scores: list[list[float]], penalty: float) -> list[int]:
    """The same on lists, which is faster for a few languages."""
    best, back = scores[0], []
    stay = list(range(len(best)))
    for row in scores[1:]:
        top = max(best)
        switch = top - penalty
        if min(best) >= switch:
            back.append(stay)
            best = [b + x for b, x in zip(best, row, strict=True)]
        else:
            i = best.index(top)
            back.append([i if b < switch else j for j, b in enumerate(best)])
            best = [(switch if b < switch else b) + x for b, x in zip(best, row, strict=True)]
    labels = [best.index(max(best))]
    for b in reversed(back):
        labels.append(b[labels[-1]])
    return labels[::-1]


def one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The language all words have in the best labelling, if that is seen without Viterbi.

    Let a stretch's gain be what a language has over the best constant one there. A labelling that comes back
    to that one pays a penalty or more for every other stretch; so does one that never has it, but for one
    stretch. It can only win if some stretch gains the penalty, or a first and a last one together.
    """
    best = int(scores.sum(0).argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, [best]], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() >= penalty:
        return None
    others = np.delete(gain, best, axis=1)
    if others.shape[1] and (np.maximum.accumulate(others.max(1)) + (others[-1] - others).max(1)).max() >= penalty:
        return None
    return best


def pieces(text: str, size: int = 0) -> list[str]:
    """text, cut between words into pieces of about size characters (SLICE, unless given)."""
    size = size or SLICE
    out, lo = [], 0
    while len(text) - lo > size:
        hi = lo + size
        while hi < len(text) and (text[hi].isalpha() or _letters()[ord(text[hi])]):
            hi += 1
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]]


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of texts: its text, letters, and scores by language."""
    slots, word, doc, size, script = words_of(texts)
    n = len(doc)
    if not n:
        return doc, size, np.zeros((0, len(model.langs)))
    slots >>= TABLE_BITS - (len(model.table).bit_length() - 1)
    picked = model.table[slots[:, 0]]
    picked += model.table[slots[:, 1]]
    picked += model.table[slots[:, 2]]
    scores = np.add.reduceat(picked, np.searchsorted(word, np.arange(n)), axis=0).astype(float)
    grams = np.bincount(word, minlength=n)[:, None] * 3
    # the mean keeps long words from outvoting all others; a word of n letters counts as sqrt(n)
    scores *= np.sqrt(size)[:, None] / np.maximum(grams, 1)
    allowed = model.allowed[script]
    allowed[~allowed.any(1)] = True
    return doc, size, np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 10)


def label_words(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of texts: its document, letters, language (number) and scores by language."""
    parts, held, chars, owners = [], [], 0, []
    for d, text in enumerate(texts):
        for piece in pieces(text):
            if held and chars + len(piece) > SLICE:
                parts.append((owners, word_scores(model, held)))
                held, chars, owners = [], 0, []
            held.append(piece)
            owners.append(d)
            chars += len(piece)
    if held:
        parts.append((owners, word_scores(model, held)))
    doc = np.concatenate([np.array(o, np.int64)[x[0]] for o, x in parts]) if parts else np.zeros(0, np.int64)
    size = np.concatenate([x[1] for _, x in parts]) if parts else np.zeros(0, np.int64)
    scores = np.concatenate([x[2] for _, x in parts]) if parts else np.zeros((0, len(model.langs)))
    labels = np.zeros(len(doc), np.int64)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        lo, hi = first[d], first[d + 1]
        if lo == hi:
            continue
        constant = one_language(scores[lo:hi], PENALTY)
        labels[lo:hi] = viterbi(scores[lo:hi], PENALTY) if constant is None else constant
    return doc, size, labels, scores


def spans(model: Model, text: str) -> list[tuple[str, int]]:
    """(language, letters) of the stretches of one text, in order."""
    _, size, labels, _ = label_words(model, [text])
    out: list[tuple[str, int]] = []
    for n, j in zip(size.tolist(), labels.tolist(), strict=True):
        if out and out[-1][0] == model.langs[j]:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((model.langs[j], n))
    return out


def predict_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, score
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= SLICE):
            chars += len(texts[hi] or "")
            hi += 1
        doc, size, labels, scores = label_words(model, [t or "" for t in texts[lo:hi]])
        k = len(model.langs)
        letters = np.bincount(doc * k + labels, size, minlength=(hi - lo) * k).reshape(-1, k)
        total = letters.sum(1)
        best = letters.argmax(1)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        for d in np.flatnonzero(total):
            at = slice(first[d], first[d + 1])
            gain = scores[at][labels[at] == best[d]].sum(0)
            gain = gain - gain[best[d]]
            gain[best[d]] = -np.inf
            sure = 1 / (1 + np.exp(np.clip(gain.max(), -30, 30))) if k > 1 else 1.0
            lang[lo + d] = model.langs[best[d]]
            score[lo + d] = letters[d, best[d]] / total[d] * sure
        lo = hi
    return lang, score


def train(docs: DataFrame) -> Model | None:
    """Fit on documents whose crc32(doc_id) mod FOLDS is not HELD_OUT; None if none has a language and a letter."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.rlike("text", F.lit(r"\p{L}")) & (bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    chance = (F.xxhash64("doc_id", F.lit("lid")).bitwiseAND(F.lit((1 << 53) - 1)) + 1).cast("double") / float(1 << 53)
    d = d.withColumn("bin", F.floor(-CHANCE_BINS * F.log2(chance)).cast("int"))
    # a row per language and bin comes back: the bins of least chance that hold TRAIN_PER_LANG documents are taken
    seen: dict[str, list[tuple[int, int]]] = {}
    for r in d.groupBy("lang", "bin").agg(F.count("*").alias("n")).toLocalIterator():
        seen.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    if not seen:
        return None
    least = []
    for lang, found in seen.items():
        n = 0
        for bin_, more in sorted(found, reverse=True):
            n += more
            if n >= TRAIN_PER_LANG:
                break
        least.append((lang, bin_))
    langs = sorted(seen)
    bits = TABLE_BITS
    while bits > 1 and len(langs) << bits > MODEL_CELLS:
        bits -= 1
    cells = 1 << bits
    cuts = spark.createDataFrame(least, "lang string, least int")  # a row per language, as the model has
    sample = d.join(F.broadcast(cuts), "lang").where("bin >= least").select("lang", "text")

    def run(batches):
        for b in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in pieces(text):
                    slots, _, _, size, script = words_of([piece])
                    if len(size):
                        x = counts.setdefault(lang, np.zeros(cells + N_SCRIPTS, np.int64))
                        x[:cells] += np.bincount(slots.ravel() >> (TABLE_BITS - bits), minlength=cells)
                        x[cells:] += np.bincount(script, minlength=N_SCRIPTS)
            for lang, x in counts.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "slot", "n"])

    def dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(cells + N_SCRIPTS)
        x[rows["slot"]] = rows["n"]
        return pd.DataFrame({"lang": [key[0]], "counts": [x.astype(np.float32).tobytes()]})

    got = sample.mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = got.groupBy("lang").applyInPandas(dense, "lang string, counts binary")
    table = {r["lang"]: np.frombuffer(r["counts"], np.float32) for r in got.toLocalIterator()}  # MODEL_CELLS numbers in all
    langs = [x for x in langs if x in table]
    if not langs:
        return None
    counts = np.stack([table[x] for x in langs], axis=1).astype(float)
    scripts, counts = counts[cells:], counts[:cells]
    allowed = scripts > 1e-3 * scripts.sum(0)
    return Model(tuple(langs), np.log((counts + 0.3) / (counts.sum(0) + 0.3 * cells)).astype(np.float32), allowed)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_CELLS numbers

    def run(batches):
        for b in batches:
            lang, score = predict_texts(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
