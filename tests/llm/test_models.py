import hashlib
import itertools
import json
import math
import random
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, PROSE, SCHEMA, empty, nasty, nasty_rows, row, same_as_sql

from sitefold.llm import chat_format as cf
from sitefold.llm import language_id as li
from sitefold.llm import quality_crf as qc
from sitefold.llm import url_filter as uf
from sitefold.llm.common import mix

TABLES = DATA.replace("0.001", "0.1")


# ---------------------------------------------------------------- quality


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(1)
    lines = np.array([1, 4, 0, 3, 6])
    scores, trans = rnd.normal(size=lines.sum()) * 2, rnd.normal(size=(2, 2))
    p, pairs = qc.marginals(scores, lines, trans)
    at, total = 0, np.zeros((2, 2))
    for n in lines:
        weight = {y: math.exp(sum(s for s, v in zip(scores[at : at + n], y, strict=True) if v) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)
        for y, w in weight.items():
            for a, b in zip(y, y[1:], strict=False):
                total[a, b] += w / z
        at += n
    assert np.allclose(pairs, total)


def test_line_features_see_every_line():
    texts = ["a b\nC!!\n\nc d", "", "\n", "x", "\nA|B|\nlast", None, "no newline at all", "s s s s\ns s s s\nd"]
    data, offsets = qc.string_bytes(pa.array(texts))
    own, weight, lines = qc.line_features(data, offsets)
    assert lines.tolist() == [len((t or "").split("\n")) for t in texts]
    assert len(own) == lines.sum() and own.shape[1] == qc.N_OWN and np.isfinite(own).all()
    flat = [x for t in texts for x in (t or "").split("\n")]
    assert weight.tolist() == [len(x.replace(" ", "")) for x in flat]
    bang = own[:, qc._MEASURES.index("bang")]
    assert [round(b * max(1, len(x))) for b, x in zip(bang, flat, strict=True)] == [x.count("!") for x in flat]
    repeated = own[:, len(qc._MEASURES) + 5]
    assert [i for i, x in enumerate(repeated) if x] == [flat.index("s s s s") + 1]
    x = qc.with_neighbours(own, lines)
    assert (x[0, qc.N_OWN : 2 * qc.N_OWN] == 0).all() and (x[1, qc.N_OWN : 2 * qc.N_OWN] == own[0]).all() and (x[3, 2 * qc.N_OWN : 3 * qc.N_OWN] == 0).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    got = qc.score(docs, qc.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_dont_depend_on_ids_or_company(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    model = qc.train(docs, labels)
    texts = [r["text"] for r in docs.limit(60).collect()]
    together = qc.score_texts(model, pa.array(texts))
    assert np.allclose(together, [qc.score_texts(model, pa.array([t]))[0] for t in texts])


def test_quality_learns_from_long_documents(spark):
    good, bad = "The old harbour was quiet that morning, and boats lay still.", "!!! $$$ 777 ### !!! $$$"
    docs = [row(i, "\n".join([bad] * (qc.TRAIN_LINES + 20) if i % 2 else [good] * 5)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r["predicted"] for r in qc.score(docs, qc.train(docs, labels)).collect()}
    assert got == {i: 1 - i % 2 for i in range(60)}


def test_scores_equal_brute_force_over_labellings(spark):
    """From texts to scores: every labelling of a text's lines is weighed by the field, and lines by their bytes."""
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    model = qc.train(docs, labels)
    rows = [r for r in docs.select("doc_id", "text").collect() if 0 < len((r["text"] or "").split()) and r["text"].count("\n") < 8][:40]
    got = {r["doc_id"]: r["score"] for r in qc.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        lines = text.split("\n")
        own, weight, n = qc.line_features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert n.tolist() == [len(lines)] and weight.tolist() == [sum(b not in b" \t\n\r\f\v" for b in x.encode()) for x in lines]
        z = (own - model.mean) / model.scale
        none = np.zeros(z.shape[1])
        s = [float(np.concatenate((z[i], z[i - 1] if i else none, z[i + 1] if i + 1 < len(z) else none, [1])) @ model.weights) for i in range(len(z))]
        s = [min(max(x, -30), 30) for x in s]
        total, good = 0.0, np.zeros(len(s))
        for y in itertools.product((0, 1), repeat=len(s)):
            w = math.exp(sum(x / 2 if a else -x / 2 for x, a in zip(s, y, strict=True)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
        raw = min(max(float((weight * good / total).sum() / weight.sum()), 1e-4), 1 - 1e-4)
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log(raw / (1 - raw)) + model.shift))), abs=1e-6)


def test_quality_on_nasty_rows(spark):
    labels = [(i, i % 2, 0) for i in range(1, 21)] + [(None, 1, 0), (5, None, 0), (6, 7, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for table in (labels, labels.where("quality = 1"), labels.where("quality = 0"), labels.where("false")):
        got = qc.score(nasty(spark), qc.train(nasty(spark), table)).collect()
        assert len(got) == len(nasty_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert all(r["score"] == qc.EMPTY_SCORE for r in got if r["doc_id"] in (1, 2, 3))
    model = qc.train(empty(spark), labels)
    assert qc.score(empty(spark), model).count() == 0
    kept = qc.keep_good(nasty(spark), qc.train(nasty(spark), labels.where("quality = 1")))
    assert kept.columns == nasty(spark).columns and {r["doc_id"] for r in kept.collect()} >= {6, 9}


# ---------------------------------------------------------------- chat


def test_chats_equal_sql(spark):
    same_as_sql(cf.op8_chat_format(spark, DATA), cf.ORACLE["op8_chat_format"])


def test_round_trip_and_mask(spark):
    rnd = random.Random(1)
    parts = ["\\", "<", ">", "l", "g", "\\l", "</turn>\n", "<turn user>", "\n", "é", "日", " ", ""]
    rows, want = [], defaultdict(list)
    for conv in range(40):
        for turn in range(rnd.randrange(1, 6)):
            role = rnd.choice(["user", "assistant", "system", None, "<x>\\l"])
            text = rnd.choice([None, "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))])
            rows.append((conv, turn, role, text, "extra"))
            want[conv].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    for r in cf.read_back(cf.format_turns(cf.turns_from_rows(df))).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count("</turn>\n") == len(want[r["conv_id"]])


def test_layouts_by_fingerprint(spark):
    hi, yo = "hi <b>", "yo \\"
    records = [
        {"prompt": hi, "response": yo}, {"prompt": hi, "completion": yo}, {"question": hi, "answer": yo}, {"instruction": hi, "output": yo}, {"instruction": hi, "input": "", "output": yo},
        {"messages": [{"role": "user", "content": hi}, {"role": "assistant", "content": yo}]}, {"conversations": [{"from": "human", "value": hi}, {"value": yo, "from": "gpt"}]},
        {"output": yo, "system": "s", "instruction": hi}, {"prompt": hi, "other": 1}, {"prompt": {"text": hi}, "response": yo},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "not json"), (92, "[]")], "conv_id long, record string")
    got = defaultdict(list)
    for r in cf.turns_from_json(df).orderBy("conv_id", "pos").collect():
        got[r["conv_id"]].append((r["pos"], r["role"], r["text"]))
    plain = [(0, "user", hi), (1, "assistant", yo)]
    assert all(got[i] == plain for i in range(7)) and got[7] == [(0, "system", "s"), (1, "user", hi), (2, "assistant", yo)]
    assert set(got) == set(range(8))
    apart = {r["conv_id"]: r["record"] for r in cf.unknown_records(df).collect()}
    assert set(apart) == {8, 9, 90, 91, 92} and json.loads(apart[9]) == records[9] and apart[91] == "not json"


def test_other_fields_change_no_layout(spark):
    """A speaker's name or an id is no other layout; lists of parts and fields of two layouts are, and come back whole."""
    said = [{"role": "user", "content": "a", "name": "Ann"}, {"role": "assistant", "content": None, "tool": {"x": 1}}]
    records = [{"messages": said, "id": 7}, {"prompt": "a", "response": "b", "score": 0.5}, {"messages": [{"role": "user", "content": [{"text": "a"}]}]}, {"prompt": "a", "response": "b", "system": "s"}, {"messages": []}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in cf.read_back(cf.format_turns(cf.turns_from_json(df))).collect()}
    assert got == {0: [("user", "a"), ("assistant", "")], 1: [("user", "a"), ("assistant", "b")]}
    assert {r["conv_id"]: json.loads(r["record"]) for r in cf.unknown_records(df).collect()} == dict(enumerate(records[2:], 2))


def test_very_long_chats(spark):
    text = "<\\> word " * 200_000
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = cf.digests(cf.format_turns(cf.turns_from_rows(df))).first()
    assert r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chats_on_nasty_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (1, None, "b", "2"), (1, None, "a", "1"), (1, None, "a", "1")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in cf.digests(cf.format_turns(cf.turns_from_rows(df))).collect()}
    assert got[None]["n_turns"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(b"a\n1\na\n1\nb\n2\n").hexdigest() and got[1]["loss_chars"] == 0
    assert cf.digests(cf.format_turns(cf.turns_from_rows(df.where("false")))).count() == 0
    with pytest.raises(ValueError):
        cf.turns_from_rows(df.drop("text"))


def test_chats_run_no_python(spark):
    plan = cf.op8_chat_format(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- language


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(0)

    def value(s, labels, penalty):
        return s[np.arange(len(s)), labels].sum() - penalty * (np.diff(labels) != 0).sum()

    for _ in range(400):
        n, k = rnd.integers(1, 6), rnd.integers(1, 4)
        s, penalty = rnd.normal(size=(n, k)) * rnd.choice([0.5, 2, 5]), rnd.choice([0.5, 2, 6])
        best = max(value(s, np.array(y), penalty) for y in itertools.product(range(k), repeat=int(n)))
        assert value(s, li.viterbi(s, penalty), penalty) == pytest.approx(best)
        wide = np.concatenate((s, np.full((n, 9), -1e3)), axis=1)
        assert value(wide, li.viterbi(wide, penalty), penalty) == pytest.approx(best)
        one = li.one_language(s, penalty)
        assert one is None or value(s, np.full(n, one), penalty) == pytest.approx(best)


@pytest.fixture(scope="module")
def model(spark):
    return li.train(spark.read.parquet(f"{TABLES}/documents.parquet"))


def test_held_out_languages(spark, model):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = li.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 500 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_spans_of_mixed_text(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").where("n_chars BETWEEN 500 AND 900 AND doc_id < 400").collect()}
    en, fr = docs["en"][:300], docs["fr"][:300]
    spans = li.spans(model, en + " " + fr + " " + en)
    assert [s[0] for s in spans] == ["en", "fr", "en"]
    assert sum(n for _, n in spans) == sum(c.isalpha() for c in (en + fr + en).lower())


def test_scripts_narrow_candidates():
    table = np.zeros((1 << li.TABLE_BITS, 2), np.float32)
    allowed = np.zeros((li.N_SCRIPTS, 2), bool)
    allowed[1, 0] = allowed[3, 1] = True
    lang, _ = li.predict_texts(li.Model(("latin", "cyrillic"), table, allowed), ["hello there", "привет всем", "12 34 !", None, ""])
    assert lang == ["latin", "cyrillic", "und", "und", "und"]


def test_predictions_dont_depend_on_company(model):
    texts = [PROSE, None, "", "Étion dans çouelle", "x", "ñ", "日本語", PROSE * 50]
    lang, score = li.predict_texts(model, texts)
    for t, a, b in zip(texts, lang, score, strict=True):
        one = li.predict_texts(model, [t])
        assert one[0] == [a] and one[1][0] == pytest.approx(b)


def test_marks_alone_are_no_letters(spark, model):
    assert li.predict_texts(model, ["\u0301", " \u0301\u0302 12 \u20dd"])[0] == ["und", "und"]
    docs, size, *_ = li.label_words(model, ["e\u0301te\u0301 \u0301x"])
    assert size.tolist() == [3, 1]


def brute_words(text):
    """(letters, slots of its n-grams, script) of every word."""
    out, word, text = [], "", text.lower()
    for c in text + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        elif word:
            code = [0, 0, *map(ord, word), 0]
            slots = []
            for i in range(2, len(code)):
                a, b, c_ = code[i - 2] if code[i - 1] else 0, code[i - 1], code[i]
                for n, x in enumerate((c_, c_ | b << 21, c_ | b << 21 | a << 42)):
                    slots.append(int(mix(np.array([x], np.uint64) ^ li._ORDER_SALT[n])[0]) >> (64 - li.TABLE_BITS))
            script = next((s for lo, hi, s in li.SCRIPT_RANGES if lo <= ord(word[0]) <= hi), 0)
            out.append((sum(unicodedata.category(x)[0] == "L" for x in word), slots, script))
            word = ""
    return out


def brute_languages(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % li.FOLDS == li.HELD_OUT
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and not held(i):
            for _, slots, script in brute_words(text or ""):
                counts[lang].update(slots)
                scripts[lang][script] += 1
    langs = sorted(counts)
    log = lambda lang, x: math.log((counts[lang][x] + 0.3) / (sum(counts[lang].values()) + 0.3 * (1 << li.TABLE_BITS)))
    out = {}
    for i, text, _ in rows:
        words = brute_words(text or "")
        if not words:
            out[i] = ("und", 0.0)
            continue
        table = []
        for n, slots, script in words:
            s = {x: math.sqrt(n) / len(slots) * sum(log(x, y) for y in slots) for x in langs}
            fits = [x for x in langs if scripts[x][script] > 1e-3 * sum(scripts[x].values())]
            table.append(s if not fits else {x: v if x in fits else min(s.values()) - 10 for x, v in s.items()})
        best = [{x: (v, [x]) for x, v in table[0].items()}]
        for s in table[1:]:
            best.append({x: max(((b[0] - li.PENALTY * (y != x) + s[x], [*b[1], x]) for y, b in best[-1].items()), key=lambda t: t[0]) for x in langs})
        labels = max(best[-1].values(), key=lambda t: t[0])[1]
        letters = Counter()
        for (n, _, _), x in zip(words, labels, strict=True):
            letters[x] += n
        lang = max(langs, key=lambda x: letters[x])
        gain = max(sum(s[y] - s[lang] for s, x in zip(table, labels, strict=True) if x == lang) for y in langs if y != lang)
        out[i] = (lang, letters[lang] / sum(letters.values()) / (1 + math.exp(min(max(gain, -30), 30))))
    return out


def test_predictions_equal_brute_force(spark):
    """From the table to the verdict: sample, counts, scripts, word scores, Viterbi and vote."""
    got = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 400").select("doc_id", "text", "lang").collect()[:60]
    rows = [tuple(r) for r in got] + [(10_000 + i, f"{a[1][:90]} {b[1][:120]}", None) for i, (a, b) in enumerate(zip(got, got[7:], strict=False))]
    rows += [(20_000 + i, t, "ru") for i, t in enumerate(["привет всем друзья", "мир и труд", "hello мир", "e\u0301te\u0301", None, "\u0301", "12"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute_languages(rows)
    for r in li.predict(docs, li.train(docs)).collect():
        assert (r["lang_pred"], r["score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], abs=1e-3))


def test_no_language_is_left_out(spark, monkeypatch):
    """Languages of long texts only, and more of them than the model has room for at full size."""
    monkeypatch.setattr(li, "MODEL_CELLS", 1 << 20)
    rnd = random.Random(9)
    texts = {f"l{i:02d}": ["".join(rnd.choice("bcdfghjklmnp") + rnd.choice("aeiou") for _ in range(4)) for _ in range(40)] for i in range(20)}
    rows = [(100 * j + i, " ".join(rnd.choice(words) for _ in range(6000 if i < 6 else 30)), lang if i < 6 else None) for j, (lang, words) in enumerate(texts.items()) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs)
    assert len(model.langs) == 20 and model.table.size <= 1 << 20
    got = {r["doc_id"]: r["lang_pred"] for r in li.predict(docs, model).collect()}
    assert all(got[i] == f"l{i // 100:02d}" for i, _, _ in rows)


def test_pieces_of_a_long_text_change_nothing(model, monkeypatch):
    text = (PROSE + " e\u0301tude ") * 30
    whole = li.predict_texts(model, [text, "une autre phrase"])
    monkeypatch.setattr(li, "SLICE", 50)
    assert "".join(li.pieces(text, 50)) == text
    parts = li.predict_texts(model, [text, "une autre phrase"])
    assert parts[0] == whole[0] and parts[1] == pytest.approx(whole[1])


def test_language_on_nasty_rows(spark):
    got = li.predict(nasty(spark), li.train(nasty(spark))).collect()
    assert len(got) == len(nasty_rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in ("en", "xx") for r in got if r["doc_id"] in (6, 9))
    assert {r["lang_pred"] for r in li.predict(nasty(spark), None).collect()} == {"und"}
    assert li.train(empty(spark)) is None and li.predict(empty(spark), None).count() == 0


# ---------------------------------------------------------------- urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for rule, allow in uf.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, allow))
    return host, path, max(fits, default=(0, None, None))[1]


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/1#a", "http://xorg/", "http://a.org", "http://a.org/", "http://b.com/fr/://x", "x://É.com/de/?", "http://a.com\n/fr/", "://h/p", "http://a.example.org/en/2", "a?b://c.org/x"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(None, "http://a.net/", "c", 1)], "page_id long, url string, host string, s int")
    got = {r["page_id"]: r for r in uf.url_filter(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        if rule:
            assert got[i]["verdict"] == ("allow" if dict(uf.RULES)[rule] else "block")
    assert got[None]["verdict"] in ("allow", "block") and got[0]["score"] == 0
    assert uf.url_filter(df.where("false")).count() == 0


def brute_scores(urls):
    """urls: (s, n, label, calibrates) -> score of each, by recursion over contexts."""
    counts = [defaultdict(Counter), defaultdict(Counter)]
    letters = set()
    pad = lambda s: uf._START * uf.ORDER + s + uf._STOP
    for s, n, label, calibrates in urls:
        t = pad(s)
        for i in range(uf.ORDER, len(t)):
            letters.add(t[i])
            for k in range(uf.ORDER + 1):
                if label is not None and not calibrates:
                    counts[0 if label else 1][t[i - k : i]][t[i]] += n

    def p(c, context, ch):
        lower = p(c, context[1:], ch) if context else 1 / (len(letters) + 1)
        seen = c[context]
        return (seen[ch] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    out = {}
    for s, *_ in urls:
        t = pad(s)
        x = sum(round((math.log(p(counts[0], t[i - uf.ORDER : i], t[i])) - math.log(p(counts[1], t[i - uf.ORDER : i], t[i]))) * uf.UNIT) for i in range(uf.ORDER, len(t)))
        out[s] = x / uf.UNIT / (len(s) + 1)
    return out


@pytest.mark.parametrize("hot", [1, 50, 4096])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(uf, "HOT", hot)
    rnd = random.Random(4)
    urls = [(f"{rnd.choice('abc')}{rnd.choice(['x.net', 'casino.org', 'é.com'])}/{rnd.choice(['en', 'fr', ''])}{i % 13}{i}", rnd.randrange(1, 4), rnd.choice([True, False, None]), i % 5 == 0) for i in range(80)]
    ids = {hashlib.md5(s.encode()).digest(): s for s, *_ in urls}
    got = {ids[bytes(r["id"])]: r["score"] for r in uf.scores(spark.createDataFrame(urls, "s string, n long, label boolean, calibrates boolean")).collect()}
    want = brute_scores(urls)
    assert set(got) == {s for s, _, label, calibrates in urls if label is None or calibrates}
    assert all(got[s] == pytest.approx(want[s], abs=1e-4) for s in got)


def test_models_tell_urls_apart(spark):
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.org/{word('abcde')}") for i in range(200)] + [(1000 + i, f"http://{word('vwxyz')}.com/de/{word('vwxyz')}") for i in range(200)]
    rows += [(2000 + i, f"http://{word('abcde')}.net/{word('abcde')}") for i in range(50)] + [(3000 + i, f"http://{word('vwxyz')}.net/{word('vwxyz')}") for i in range(50)]
    got = {r["page_id"]: r["verdict"] for r in uf.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(50)) >= 48 and sum(got[3000 + i] == "block" for i in range(50)) >= 48


def test_threshold_parts_labels_best(spark):
    df = spark.createDataFrame([(0.5, True, 3), (0.1, False, 2), (-0.4, False, 1), (0.05, True, 1)], "score double, label boolean, n long")
    assert uf.threshold(df) == pytest.approx(0.305)
    assert uf.threshold(df.where("label")) == 0.0 and uf.threshold(df.where("false")) == 0.0


def test_verdicts_equal_brute_force(spark):
    """Rules, models, threshold and verdict of every page, repeated and null URLs among them."""
    rnd = random.Random(8)
    hosts = ["example.org", "a.example.org", "b.org", "shop.com", "c.net", "d.net", None]
    urls = [None if h is None else f"http://{h}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{rnd.randrange(40)}" for h in (rnd.choice(hosts) for _ in range(300))]
    got = uf.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    judged = [brute_url(u) for u in urls]
    allowed = dict(uf.RULES)
    counts = Counter(h + p for h, p, _ in judged if h + p)
    label = {h + p: allowed.get(rule) for h, p, rule in judged}
    known = [(s, n, label[s], zlib.crc32(s.encode()) % uf.FOLDS == 0) for s, n in counts.items()]
    score = brute_scores(known) | {"": 0.0}
    tried = [(score[s], want, n) for s, n, want, calibrates in known if calibrates and want is not None]
    best, at = (0.0, 0.0), 0.0  # the middle between neighbouring bins of a hundredth, as near 0 as may be
    bins = sorted({math.floor(x * 100) for x, _, _ in tried}, reverse=True)
    total = [sum(n for _, w, n in tried if w == side) for side in (True, False)]
    for b, lower in zip(bins, [*bins[1:], None], strict=True):
        above = [sum(n for x, w, n in tried if w == side and math.floor(x * 100) >= b) for side in (True, False)]
        cut = b / 100 if lower is None else (b + lower + 1) / 200
        if (above[0] / total[0] - above[1] / total[1], -abs(cut)) > best:
            best, at = (above[0] / total[0] - above[1] / total[1], -abs(cut)), cut
    for r in got:
        h, p, rule = judged[r["page_id"]]
        want = allowed[rule] if rule else score[h + p] >= at
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, rule, "allow" if want else "block")
    assert len(got) == 300 and all(total)


def test_very_long_urls_cost_their_length(spark):
    rows = [(1, "http://a.net/" + "ab/" * 350_000), (2, "http://b.org/x"), (3, "http://b.com/de/y"), (4, None)] + [(10 + i, "http://same.net/") for i in range(50)]
    start = time.time()
    got = {r["page_id"]: r for r in uf.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - start < 60 and len(got) == 54
    assert len(got[1]["path"]) == 1_050_001 and got[2]["verdict"] == "allow" and got[3]["verdict"] == "block"


def test_prose_scores_as_itself():
    assert qc.score_texts(qc.Model(*[np.zeros(1)] * 4, 1.0, 0.0, 1.0), pa.array([PROSE, ""])).tolist() == [1.0, qc.EMPTY_SCORE]
    assert row(1, PROSE)[1] == PROSE and SCHEMA
