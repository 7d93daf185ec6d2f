"""Tables that try what rows can hold."""

import os
import re

import duckdb

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, d bigint, h bigint, fp string, kept string, score string, uid string, size string, label string, component string, words string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of old herbs near the river and nobody sees them leave at dawn"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, "x", "y", "z", "u", "big", "l", "c", "w")


def nasty_rows():
    words = PROSE.split()
    long_text = " ".join(f"{words[i % len(words)]}{i // 7}" for i in range(30_000))
    return [
        row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "one"), row(5, "one two three"), row(6, PROSE), row(7, PROSE.upper()), row(8, PROSE + " again"),
        row(9, long_text), row(10, long_text), row(11, long_text + " end"), row(12, PROSE, None, None), row(13, PROSE.replace("fox", "cat"), "en", None), row(None, PROSE), row(None, None),
        row(14, "Ünïcödé 日本語 текст \U0001f600 " * 20, "xx"), row(15, "a " * 200), row(16, "#$% | <turn x> \\l </turn>\n" * 5), row(17, PROSE + "\n" + PROSE), row(18, "\x1c\x85　x"), row(18, "\x1c\x85　x"),
        row(19, PROSE, "en", "s2"), row(19, PROSE, "en", "s2"), row(20, "twenty different words", "en", ""),
    ]


def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def oracle(sql):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def oracle_on(rows, sql):
    """SQL over these rows as the only table, documents."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (" + SCHEMA.replace("string", "varchar") + ")")
    if rows:
        con.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same_as_sql(df, sql, rows=None):
    names, want = oracle(sql) if rows is None else oracle_on(rows, sql)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want, key=repr)
