"""Token predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import UNK_ID, lookup, vocab_dim

ColumnLike = Column | str

TICKS_PER_WHOLE = 96
TICKS_PER_QUARTER = 24

# The three barline sets in use.
BARLINE_SETS = {
    "eval": ("barline", "barline-final", "barline-start-repeat", "barline-end-repeat"),
    "dataset": ("barline", "barline-final", "barline-end-repeat", "barline-start-repeat",
                "barline-double"),
    "notes": ("barline", "barline-double", "barline-final", "barline-end-repeat"),
}
STRIPPED_SPECIALS = ("<SOS>", "<EOS>", "<PAD>")
HEADER_SPECIALS = ("<SOS>", "<EOS>", "<PAD>", "<UNK>")
NOTE_PREFIXES = ("note-", "chord-", "rest-", "dur-")
HEADER_PREFIXES = ("clef-", "key-", "time-")
# Fifths count per key name, and the order in which letters are altered.
KEY_FIFTHS = {"C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F#": 6,
              "F": -1, "Bb": -2, "Eb": -3, "Ab": -4, "Db": -5, "Gb": -6}
SHARP_ORDER = "FCGDAEB"
FLAT_ORDER = "BEADGCF"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def starts_with_any(c: ColumnLike, prefixes) -> Column:
    c = col(c)
    expr = c.startswith(prefixes[0])
    for p in prefixes[1:]:
        expr = expr | c.startswith(p)
    return expr


def is_note(c: ColumnLike) -> Column:
    return col(c).startswith("note-")


def is_rest(c: ColumnLike) -> Column:
    return col(c).startswith("rest-")


def is_chord(c: ColumnLike) -> Column:
    return col(c).startswith("chord-")


def is_barline(c: ColumnLike, barlines: str = "eval") -> Column:
    return col(c).isin(*BARLINE_SETS[barlines])


def is_header(c: ColumnLike, specials: bool = False) -> Column:
    """clef/key/time tokens; ``specials`` adds the dataset path's special tokens."""
    expr = starts_with_any(c, HEADER_PREFIXES)
    return (expr | col(c).isin(*HEADER_SPECIALS)) if specials else expr


def is_note_token(c: ColumnLike) -> Column:
    return starts_with_any(c, NOTE_PREFIXES)


def suffix(c: ColumnLike, prefix: str) -> Column:
    """Text after a known prefix."""
    return F.substr(col(c), F.lit(len(prefix) + 1))


def token_category(c: ColumnLike) -> Column:
    """First matching category."""
    c = col(c)
    return (F.when(is_note_token(c), "note/rest")
            .when(is_barline(c, "eval"), "barline")
            .when(c == "staff-bass", "staff-bass")
            .when(is_header(c), "header")
            .when(starts_with_any(c, ("dynamic-", "hairpin-")), "dynamic")
            .when(starts_with_any(c, ("artic-", "ornament-")) | (c == "fermata"), "artic")
            .when(c.contains("slur") | c.contains("tuplet") | c.contains("ottava"), "span")
            .otherwise("other"))


_FRACTION = r"^(?:dur|rest)-([0-9]+)/([0-9]+)$"


def duration_ticks(c: ColumnLike) -> Column:
    """``dur-a/b`` or ``rest-a/b`` in ticks (96 per whole note); NULL when malformed.

    The pattern runs only on tokens with the right prefix."""
    c = col(c)
    num = F.regexp_extract(c, _FRACTION, 1).try_cast("int")
    den = F.nullif(F.regexp_extract(c, _FRACTION, 2).try_cast("int"), F.lit(0))
    return F.when(starts_with_any(c, ("dur-", "rest-")),
                  F.floor(num * TICKS_PER_WHOLE / den).cast("int"))


def duration_ticks_or_quarter(c: ColumnLike) -> Column:
    """Malformed values count as a quarter."""
    return F.coalesce(duration_ticks(c), F.lit(TICKS_PER_QUARTER))


def explode_tokens(labels: DataFrame, key: str = "score_id", tokens: str = "tokens") -> DataFrame:
    """One row per token. Shuffle the compact arrays (if at all) before, not after."""
    return labels.select(key, F.posexplode(tokens).alias("pos", "token"))


def strip_specials(tokens: ColumnLike) -> Column:
    """The label array without SOS / EOS / PAD."""
    return F.filter(col(tokens), lambda t: ~t.isin(*STRIPPED_SPECIALS))


def encode(tokens: DataFrame) -> DataFrame:
    """Adds ``id``; tokens outside the vocabulary get the UNK id."""
    dim = vocab_dim(tokens.sparkSession).select("token", "id")
    return (tokens.join(F.broadcast(dim), "token", "left")
            .withColumn("id", F.coalesce("id", F.lit(UNK_ID))))


def decode(ids: DataFrame) -> DataFrame:
    """T4: adds ``token``; unknown ids become ``<UNK>``."""
    dim = vocab_dim(ids.sparkSession).select("id", "token")
    return (ids.join(F.broadcast(dim), "id", "left")
            .withColumn("token", F.coalesce("token", F.lit("<UNK>"))))


def truncate(tokens: DataFrame, max_seq: int) -> DataFrame:
    """T5."""
    return tokens.filter(F.col("pos") < max_seq)


def key_fifths(key_name: ColumnLike) -> Column:
    return lookup(col(key_name), KEY_FIFTHS, F.lit(0))


def key_accidental(key_name: ColumnLike, letter: ColumnLike) -> Column:
    """``#``, ``b`` or NULL for a letter under a key; unknown keys alter nothing."""
    n, letter = key_fifths(key_name), col(letter)
    return (F.when((n > 0) & (F.instr(F.lit(SHARP_ORDER), letter) <= n), "#")
            .when((n < 0) & (F.instr(F.lit(FLAT_ORDER), letter) <= -n), "b"))


def is_real_photo(filename: ColumnLike) -> Column:
    """Photographs are jpg/jpeg, renderings are png."""
    return F.lower(col(filename)).rlike(r"\.(jpg|jpeg)$")


def upload_stem(filename: ColumnLike, default: str = "새 악보") -> Column:
    """File stem; an empty name gets the default title."""
    base = F.regexp_extract(F.coalesce(F.nullif(col(filename), F.lit("")), F.lit(default)),
                            r"([^/]*)$", 1)
    stem = F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", base).otherwise(stem)


def normalize_job_status(status: ColumnLike, output: ColumnLike) -> Column:
    """Provider status to FAILED / COMPLETED / pass-through / UNKNOWN."""
    status = col(status)
    failed_output = F.get_json_object(col(output), "$.error").isNotNull()
    return (F.when(status.isin("FAILED", "CANCELLED", "TIMED_OUT"), "FAILED")
            .when((status == "COMPLETED") & failed_output, "FAILED")
            .when(status.isNull() | (status == ""), "UNKNOWN")
            .otherwise(status))
