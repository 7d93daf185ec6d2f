import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import DATA, SCHEMA, empty, lower, nasty, nasty_rows, row, same_as_sql, words_of

from sitefold.llm import components as cc
from sitefold.llm import exact_dedup as ed
from sitefold.llm import near_dedup as nd


# ---------------------------------------------------------------- exact


@pytest.mark.parametrize("name", ["op2_exact_dedup"])
def test_exact_equals_sql(spark, name):
    same_as_sql(ed.op2_exact_dedup(spark, DATA), ed.ORACLE[name])


def test_fingerprints_compose():
    powers = ed._chunk_powers(ed.PRIMES)
    raw = np.random.default_rng(1).integers(0, 256, 20_001).astype(np.uint8)
    for cut in (0, 1, 4096, 7000, 20_001):
        whole = ed.fingerprint(raw, powers)
        for j, p in enumerate(ed.PRIMES):
            a, b = ed.fingerprint(raw[:cut], powers)[j], ed.fingerprint(raw[cut:], powers)[j]
            assert ed.combine((a, cut), (b, len(raw) - cut), p) == (whole[j], len(raw))
    h = 0
    for x in raw.tolist():
        h = (h * ed.BASE + x) % ed.PRIMES[0]
    assert h == whole[0]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    return {text: (max((i for i in ids if i is not None), default=None), len(ids)) for text, ids in groups.items()}


@pytest.mark.parametrize("options", [{}, {"primes": (2, 3)}, {"huge": 40, "section": 7}, {"huge": 100, "section": 64, "primes": (3, 5)}])
def test_exact_on_nasty_rows(spark, options):
    """Tiny primes make nearly all texts of one length collide, and comparison parts them again; small sections split texts."""
    rows = nasty_rows() + [row(100 + i, f"text {i % 7:02d}") for i in range(40)]
    same_as_sql(ed.exact_dedup(spark.createDataFrame(rows, SCHEMA), **options), ed.ORACLE["op2_exact_dedup"], rows)


def test_repeated_rows_all_come_back(spark, monkeypatch):
    monkeypatch.setattr(ed, "REPEATS", 3)
    rows = [row(1, "a")] * 8 + [row(2, "A")]
    got = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 9, False)] * 8 + [(2, 2, 9, True)]


def test_long_texts_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ed, "PIECE", 10)
    monkeypatch.setattr(ed, "FAN", 2)
    rows = [row(i, "x" * 95 + str(i % 2)) for i in range(9)]
    same_as_sql(ed.exact_dedup(spark.createDataFrame(rows, SCHEMA), primes=(2, 3)), ed.ORACLE["op2_exact_dedup"], rows)


def test_exact_keeps_whole_rows_once(spark):
    kept = ed.keep_first(nasty(spark))
    rows = nasty_rows()
    want = {(lower(r[1]), r[0]) for r in rows if brute_exact(rows)[lower(r[1])][0] == r[0]}
    assert sorted(((lower(r["text"]), r["doc_id"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.columns == nasty(spark).columns
    assert ed.exact_dedup(empty(spark)).count() == 0 and ed.keep_first(empty(spark)).count() == 0


def test_exact_keeps_rows_with_maps_and_structs(spark):
    docs = spark.sql("SELECT id % 3 AS doc_id, 'same' AS text, map('n', id) AS m, struct(id AS n) AS s, array(id) AS a, id AS repeated, id AS bit_map FROM range(9)")
    got = ed.keep_first(docs)
    assert got.columns == docs.columns
    assert [r["doc_id"] for r in got.collect()] == [2]


# ---------------------------------------------------------------- near


def shingle_set(text, k):
    w = words_of(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k, percent=80):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {i: shingle_set(next(r[1] for r in rows if r[0] == i), k) for i in ids}
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    comp[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def variants(n, seed):
    """Texts around a few centres, at all distances, so that chains and near misses occur."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for c in range(4):
        centre = [rnd.choice(vocabulary) for _ in range(rnd.choice((12, 40, 150)))]
        for _ in range(n):
            text = list(centre)
            for _ in range(rnd.randrange(0, max(2, len(text) // 12))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            out.append(" ".join(text))
    rnd.shuffle(out)
    return [row(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_equals_brute_force(spark, seed):
    rows = variants(60, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got == brute_near(rows, 4)


def test_open_buckets_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = variants(60, 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got == brute_near(rows, 4)


def test_near_on_nasty_rows(spark):
    rows = nasty_rows()
    got = nd.near_dedup(nasty(spark), 5).collect()
    assert len(got) == len(rows)
    want = brute_near(rows, 5)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    kept = nd.keep_representatives(nasty(spark))
    assert kept.columns == nasty(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]} | {None}
    assert nd.near_dedup(empty(spark)).count() == 0


def test_near_equals_sql(spark):
    same_as_sql(nd.op5_near_dedup(spark, DATA), nd.ORACLE["op5_near_dedup"])


def test_odd_sketches_estimate_similarity():
    rnd = np.random.default_rng(7)
    errors = []
    for size in (20, 200, 2000):
        for share in (0.7, 0.8, 0.95):
            base = rnd.integers(0, 2**63, 2 * size, dtype=np.uint64)
            n = int(round(2 * size * share / (1 + share)))
            both, one = base[:n], base[n : n + (size - n)]
            other = rnd.integers(0, 2**63, size - n, dtype=np.uint64)
            a, b = np.unique(np.concatenate((both, one))), np.unique(np.concatenate((both, other)))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            _, s = nd.signatures([a, b])
            errors.append(abs(float(nd.estimate(np.bitwise_count(s[0] ^ s[1]).sum())) - true))
    assert max(errors) < 0.1 and np.mean(errors) < 0.035


@pytest.mark.parametrize("small", [-1, cc.SMALL])
def test_components_equal_a_search(spark, small):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    comp = {}
    for u, v in edges:
        a, b = comp.setdefault(u, {u}), comp.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                comp[x] = a
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "u long, v long"), small).collect()}
    assert got == {x: min(s) for x, s in comp.items() if len(s) > 1}
    assert cc.components(spark.createDataFrame([], "u long, v long"), small).count() == 0
