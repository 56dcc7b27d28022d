"""Chat formatting: a finite-state machine over roles, text segments with loss flags, and a declarative
template that can be read back.

A template names control strings; every turn becomes

    open + role + middle + text + close

and text segments carry the loss flag of their role. Control strings share a two-character start that
occurs in none of them a second time; inside roles and texts the escape character is doubled and that
start is broken up (``<|`` becomes ``<\\!|``), so no text can form a control string, not even at its
ends, and reading back restores it exactly.

The machine checks turn order: one entry per allowed step, and the states that may end a conversation.
A conversation that it rejects is still formatted, and its first bad turn is reported (the query returns both).

Defined cases: null text and null role are empty; a null conversation id is one conversation; turns are
ordered by turn, nulls first, ties by role, then text; equal rows stay as they are; an empty table gives
only the added conversation in the query, and nothing in the operator. A conversation becomes one string
by definition, so its turns meet in one row; everything else is a row-local expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import register, table


@dataclass(frozen=True)
class Template:
    open: str = "<|role|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    start: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state > role: next state
    steps: dict[str, str] = field(default_factory=lambda: {
        "start>system": "system", "start>user": "user", "system>user": "user",
        "user>assistant": "assistant", "assistant>user": "user"})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in (self.open, self.middle, self.close):
            if not c.startswith(self.start) or self.start[0] in c[1:] or self.escape in c:
                raise ValueError(f"not a control string: {c}")
        if len(self.start) != 2 or len(self.escape) != 1:
            raise ValueError("the start takes two characters, the escape one")


TEMPLATE = Template()


def escaped(text: Column, t: Template) -> Column:
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.start), F.lit(f"{t.start[0]}{t.escape}!{t.start[1]}"))


def unescaped(text: Column, t: Template) -> Column:
    e = re.escape(t.escape)
    return F.regexp_replace(text, F.lit(f"{e}(?:({e})|!)"), F.lit("$1"))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per conversation: conv, and turns (role, text) in order."""
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"),
                   F.coalesce(F.col(text), empty).alias("text"))
    return (rows.select(F.col(conv).alias("conv"), one.alias("t"))
            .groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"),
                                                                x["text"].alias("text")))
                    .alias("turns")))


def machine(turns: Column, t: Template) -> Column:
    """Struct: state after the last turn ('' once rejected), and bad, the first rejected turn or -1."""
    steps = F.create_map(*[F.lit(x) for kv in t.steps.items() for x in kv])
    first = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))

    def step(s, x):
        to = F.coalesce(F.element_at(steps, F.concat(s["state"], F.lit(">"), x["role"])), F.lit(""))
        bad = F.when(s["bad"] >= 0, s["bad"]).when(to == "", s["i"]).otherwise(-1)
        return F.struct(to.alias("state"), (s["i"] + 1).alias("i"), bad.alias("bad"))

    return F.aggregate(turns, first, step)


def segments(turns: Column, t: Template) -> Column:
    """Array of (text, loss): markup, then the escaped text, then markup, for every turn."""
    off = F.lit(False)

    def turn(x):
        head = F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.middle))
        return F.array(F.struct(head.alias("text"), off.alias("loss")),
                       F.struct(escaped(x["text"], t).alias("text"),
                                x["role"].isin(*t.loss_roles).alias("loss")),
                       F.struct(F.lit(t.close).alias("text"), off.alias("loss")))

    return F.flatten(F.transform(turns, turn))


def format_chats(chats: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """``conversations()`` to conv, segments, formatted, valid, bad_turn (null if none)."""
    m = machine(F.col("turns"), t)
    return (chats.select("conv", segments(F.col("turns"), t).alias("segments"), m.alias("m"))
            .select("conv", "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    ((F.col("m.bad") < 0) & F.col("m.state").isin(*t.ends)).alias("valid"),
                    F.when(F.col("m.bad") >= 0, F.col("m.bad")).alias("bad_turn")))


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, re.escape(t.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        pair = F.split(F.substring(p, len(t.open) + 1, 1 << 30), re.escape(t.middle))
        return F.struct(unescaped(pair[0], t).alias("role"), unescaped(pair[1], t).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, segments: Column, t: Template = TEMPLATE) -> Column:
    """All text under the loss mask, read from the formatted conversation: its turns, each kept if the flag of
    its text, the second of a turn's three segments, says so."""
    flags = F.transform(F.filter(segments, lambda s, i: i % 3 == 1), lambda s: s["loss"])
    kept = F.zip_with(read_back(formatted, t), flags, lambda x, loss: F.when(loss, x["text"]).otherwise(""))
    return F.array_join(kept, "")


#: The conversation that the query adds.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\!|') AS role_out,
    replace(replace(text, '\', '\\'), '<|', '<\!|') AS text_out,
    row_number() OVER turns - 1 AS i, lead(role) OVER turns IS NULL AS last,
    coalesce(lag(role) OVER turns, 'start') || '>' || role NOT IN ('start>system', 'start>user', 'system>user',
      'user>assistant', 'assistant>user') AS bad
  FROM rows_ WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(role_out) + length(text_out) + 23) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND bool_or(last AND role = 'assistant') AS valid, CAST(min(i) FILTER (bad) AS INTEGER) AS bad_turn
FROM esc GROUP BY conv_id"""


@register("op9_chat_formatting", OP9_SQL)
def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    out = format_chats(conversations(rows.unionByName(extra)))
    t = TEMPLATE
    loss = read_loss(F.col("formatted"), F.col("segments"), t)
    seen = F.array_join(F.transform("turns", lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (out.withColumn("turns", read_back(F.col("formatted"), t)).withColumn("loss", loss)
            .select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(seen, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"),
                    "valid", F.col("bad_turn").cast("int").alias("bad_turn")))
