"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter

import pytest
from helpers import DATA, empty, lower, nasty
from test_corpus_ops import brute_targets, check_packing
from test_dedup import brute_near

import __spark_entry__ as entry
import corpus_pipeline as cp
from sitefold.llm import quality_crf as qc
from sitefold.llm.common import cut


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return dict(zip([n for n, _ in cp.STAGES], out, strict=True))


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(a == b for n, (_, _, a, b) in stages.items() if n != "packing")


def test_quality_keeps_what_scores(spark, stages):
    before, after, _, _ = stages["quality"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["doc_id"] for r in qc.score(docs, qc.train(docs, labels)).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after} == good and 0 < len(after) < len(before)
    assert set(after) <= set(before)


def test_exact_keeps_the_last_of_each_text(stages):
    before, after, _, _ = stages["exact_dedup"]
    last = {}
    for r in before:
        last[lower(r["text"])] = max(last.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(last.values()) and set(after) <= set(before)


def test_near_keeps_one_of_each_group(stages):
    before, after, _, _ = stages["near_dedup"]
    want = brute_near([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, w in want.items() if w[2]) and set(after) <= set(before)


def test_mix_repeats_whole_documents(stages):
    before, after, _, _ = stages["mixing"]
    sizes, taken, n = Counter(), Counter(), Counter(after)
    words = lambda r: len([w for w in (r["text"] or "").replace("\n", " ").split(" ") if w])
    for r in before:
        sizes[r["source"]] += words(r)
        taken[r["source"]] += words(r) * n[r]
    assert set(after) <= set(before) and max(n.values()) <= 2
    longest = max(map(words, before))
    assert all(abs(taken[s] - t) <= longest for s, t in brute_targets(sizes).items())


def test_packing_holds_every_document(stages):
    before, after, _, _ = stages["packing"]
    check_packing(after, 2048)
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)


def test_registered(spark):
    q = entry.queries()
    assert "pipeline" in q and cp.ORACLE_SQL is None
    names = [n for n in q if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert q["pipeline"](spark, DATA).count() > 0


@pytest.mark.parametrize("table", [nasty, empty])
def test_stages_on_odd_tables(spark, table):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table, through every stage in turn."""
    docs = table(spark)
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = cut(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    if table is empty:
        assert set(sizes) == {0}
    else:
        assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] > 0 and sizes[5] > 0
        check_packing(docs.collect(), 2048)
