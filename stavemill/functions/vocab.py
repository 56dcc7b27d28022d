"""Score vocabulary (259 tokens) generated from its groups, and small literal dims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Token groups in id order. Pitch groups are spellings x octaves.
SPECIALS = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")
CLEFS = ("G", "F", "C")
KEYS = ("C", "G", "D", "A", "E", "B", "F#", "F", "Bb", "Eb", "Ab", "Db", "Gb")
TIMES = ("2/4", "3/4", "4/4", "6/8", "3/8", "12/8", "2/2", "5/4")
SPELLINGS = ("C", "C#", "Db", "D", "D#", "Eb", "E", "F", "F#", "Gb", "G", "G#", "Ab",
             "A", "A#", "Bb", "B")
OCTAVES = (2, 3, 4, 5, 6)
DURATIONS = ("1/1", "3/4", "1/2", "3/8", "1/4", "3/16", "1/8", "3/32", "1/16", "1/32")
BARLINES = ("barline", "barline-double", "barline-final", "barline-start-repeat",
            "barline-end-repeat")
DYNAMICS = ("ppp", "pp", "p", "mp", "mf", "f", "ff", "fff", "fp", "sf", "sfz")
HAIRPINS = ("hairpin-cresc-start", "hairpin-cresc-end", "hairpin-dim-start", "hairpin-dim-end")
ARTICULATIONS = ("staccato", "accent", "tenuto", "marcato", "staccatissimo")
ORNAMENTS = ("trill", "mordent", "turn")
TAIL = ("fermata", "slur-start", "slur-end", "tuplet-3-start", "tuplet-3-end",
        "ottava-8va-start", "ottava-8va-end", "ottava-8vb-start", "ottava-8vb-end",
        "trill-start", "trill-end", "staff-bass", "tie")

UNK_ID = 3
SOS_ID = 1
EOS_ID = 2
PAD_ID = 0
SYMBOL_BASE = 0x4E00  # one printable character per id; Spark's levenshtein counts characters


def vocabulary() -> list[str]:
    """All tokens; the list index is the id."""
    pitches = [f"{s}{o}" for o in OCTAVES for s in SPELLINGS]
    return [*SPECIALS,
            *(f"clef-{c}" for c in CLEFS),
            *(f"key-{k}" for k in KEYS),
            *(f"time-{t}" for t in TIMES),
            *(f"note-{p}" for p in pitches),
            *(f"dur-{d}" for d in DURATIONS),
            *(f"chord-{p}" for p in pitches),
            *(f"rest-{d}" for d in DURATIONS),
            *BARLINES,
            *(f"dynamic-{d}" for d in DYNAMICS),
            *HAIRPINS,
            *(f"artic-{a}" for a in ARTICULATIONS),
            *(f"ornament-{o}" for o in ORNAMENTS),
            *TAIL]


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    """``SELECT * FROM (VALUES ...)`` text, valid in Spark and in ANSI engines."""
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def literal_dim(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A driver-defined constant table (never derived from data, so its size is fixed)."""
    return spark.sql(values_sql(columns, rows))


def vocab_dim(spark: SparkSession) -> DataFrame:
    """``(token, id, sym)``, 259 rows; always safe to broadcast."""
    rows = [(t, i, chr(SYMBOL_BASE + i)) for i, t in enumerate(vocabulary())]
    return literal_dim(spark, ["token", "id", "sym"], rows)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{token: id}`` to ``(token, id)`` rows."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Constant dictionary as a ``CASE`` chain (stays inside whole-stage codegen)."""
    expr = None
    for k, v in table.items():
        value = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, value) if expr is None else expr.when(key == k, value)
    return expr if default is None else expr.otherwise(default)
