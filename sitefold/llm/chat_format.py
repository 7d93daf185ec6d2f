"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's layout is known by the hash of its nested field paths, of those that some mapping uses: others, such
as an id or the name of a speaker, don't change it. MAPPINGS declares, for each layout, where roles and texts
lie; the fingerprint picks the mapping, and records become canonical turns (conv_id, pos, role, text). A table
with one message a row has one layout, hashed from its schema; JSON records of mixed layouts are hashed row by
row. Records of a layout that no mapping has come back apart, whole, from unknown_records().

The template is <turn ROLE>TEXT</turn> and a newline, per turn. In roles and texts a backslash, < and >
become \\\\, \\l and \\g; so markers can't occur inside, and reading back is exact. The loss mask holds the
spans of assistants' texts.

Cases: null roles and texts are empty. Turns of one conversation are ordered by (turn, role, text), nulls
first; repeated rows are turns of their own. A null conv_id is a conversation. Extra columns are ignored. An
empty table gives no conversations. A conversation becomes one string, so it must fit into a row; very long texts
cost their length. A record that is null or no JSON is of unknown layout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """fields: (role, field) pairs, each one turn (empty ones are left out); or items: an array whose objects
    hold role and text; or rows: each row is a message. names: canonical names of roles."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    rows: bool = False
    names: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.items:
            return [f"{self.items}[].{x}" for x in (self.role, self.text)]
        return [self.role, self.text] if self.rows else [x for _, x in self.fields]


MAPPINGS = (
    Mapping("message rows", rows=True, role="role", text="text"),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("shared chats", items="conversations", role="from", text="value", names={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction with system", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.StructType) -> list[str]:
    out = []
    for f in schema.fields:
        kind, name = f.dataType, f.name
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            kind, name = kind.elementType, name + "[]"
        out += [f"{name}.{p}" for p in schema_paths(kind)] if isinstance(kind, T.StructType) else [name]
    return out


def json_fingerprint(record: Column) -> Column:
    """Of a variant's nested field paths that some mapping uses; null values count as there.

    A path is that of a scalar: where an object or an array lies, other paths begin.
    """

    def scalar(x: Column) -> Column:
        return x.isNotNull() & ~F.coalesce(F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)<"), F.lit(False))

    def at(name: str):
        return lambda x: F.try_variant_get(x, f"$.{name}", "variant")

    found = []
    for path in sorted({p for m in MAPPINGS if not m.rows for p in m.paths()}):
        items, inner, name = path.partition("[].")
        if inner:
            values = F.transform(F.try_variant_get(record, f"$.{items}", "array<variant>"), at(name))
            there = F.exists(values, scalar) & ~F.exists(values, lambda x: x.isNotNull() & ~scalar(x))
        else:
            there = scalar(F.try_variant_get(record, f"$.{path}", "variant"))
        found.append(F.when(there, F.lit(path)))
    return F.sha2(F.array_join(F.array(*found), "\n").cast("binary"), 256)


def turns_from_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Canonical turns of a table with one message a row, whose other columns' fingerprint is known."""
    known = {fingerprint(m.paths()): m for m in MAPPINGS if m.rows}
    names = {x for m in known.values() for x in m.paths()}
    found = fingerprint([p for p in schema_paths(df.schema) if p in names])
    if found not in known:
        raise ValueError(f"no mapping for the layout of {df.columns}")
    m = known[found]
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("pos"), F.col(m.role).cast("string").alias("role"), F.col(m.text).cast("string").alias("text"))


def _read_json(df: DataFrame, conv: str, record: str) -> DataFrame:
    d = df.select(F.col(conv).alias("conv_id"), F.col(record).alias("record"), F.try_parse_json(F.col(record)).alias("v"))
    return d.withColumn("fp", json_fingerprint(F.col("v")))


def _known() -> list[str]:
    return [fingerprint(m.paths()) for m in MAPPINGS if not m.rows]


def turns_from_json(df: DataFrame, conv: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of mixed layouts, of those that some mapping knows."""
    d = _read_json(df, conv, record).where(F.col("fp").isin(_known()))
    message = "array<struct<role: string, text: string>>"
    turns = F.lit(None).cast(message)
    for m in MAPPINGS:
        if m.rows:
            continue
        if m.items:
            items = F.try_variant_get("v", f"$.{m.items}", f"array<struct<`{m.role}`: string, `{m.text}`: string>>")
            got = F.transform(items, _turn(m))
        else:
            each = [(role, F.try_variant_get("v", f"$.{f}", "string")) for role, f in m.fields]
            got = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), x.alias("text")) for role, x in each]), lambda t: F.coalesce(t["text"], F.lit("")) != "")
        turns = F.when(F.col("fp") == fingerprint(m.paths()), got.cast(message)).otherwise(turns)
    d = d.select("conv_id", F.posexplode_outer(turns).alias("pos", "t"))
    return d.select("conv_id", F.col("pos").cast("long").alias("pos"), "t.role", "t.text")


def unknown_records(df: DataFrame, conv: str = "conv_id", record: str = "record") -> DataFrame:
    """conv_id, record, fingerprint of the records that no mapping knows."""
    return _read_json(df, conv, record).where(F.coalesce(~F.col("fp").isin(_known()), F.lit(True))).select("conv_id", "record", F.col("fp").alias("fingerprint"))


def _turn(m: Mapping):
    return lambda x: F.struct(_renamed(x[m.role], m.names).alias("role"), x[m.text].alias("text"))


def _renamed(role: Column, names: dict[str, str]) -> Column:
    out = role
    for old, new in names.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    """Pairs of backslashes are split off first, from the left; what is between them has no other backslash but of \\l and \\g."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(plain, "\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, pos, role, text) -> conv_id, formatted, loss_spans (array of start, length; from 0)."""
    t = turns.select("conv_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    t = t.select("conv_id", (F.col("role") == LOSS_ROLE).alias("loss"), F.row_number().over(order).alias("i"), head.alias("head"), escape(F.col("text")).alias("body"))
    by_i = Window.partitionBy("conv_id").orderBy("i")
    size = (F.char_length("head") + F.char_length("body") + len(END)).cast("long")
    t = t.withColumn("start", F.sum(size).over(by_i) - size + F.char_length("head"))
    part = F.struct("i", F.concat("head", "body", F.lit(END)).alias("piece"), "loss", "start", F.char_length("body").cast("long").alias("length"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    masked = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return g.select("conv_id", F.array_join("parts.piece", "").alias("formatted"), masked.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted(conv_id, formatted, loss_spans) -> with turns (array of role, text) and loss_text, both unescaped."""
    split = F.split("formatted", END)
    parts = F.slice(split, F.lit(1), F.size(split) - 1)
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substring(F.split_part(p, F.lit(CLOSE), F.lit(1)), len(OPEN) + 1, 1 << 30)).alias("role"), unescape(F.split_part(p, F.lit(CLOSE), F.lit(2))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def digests(formatted: DataFrame) -> DataFrame:
    b = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return b.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, which comes in another layout."""
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(HARD).alias("prompt"), F.lit(HARD).alias("response"))).alias("record"))
    turns = turns_from_rows(read(spark, sf_dir, "conversations")).unionByName(turns_from_json(hard))
    return digests(format_turns(turns))


ORACLE = {
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<>]')) + 15 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
}
