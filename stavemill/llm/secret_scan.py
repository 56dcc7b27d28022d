"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov chains over characters are trained from labelled samples: strings that the base
patterns find are random, other tokens of sampled documents are ordinary; those that look
random by their characters alone are left out. A token of at least ``MIN_TOKEN``
characters outside the base spans is reported as ``markov`` when it has a letter and its log-likelihood
ratio exceeds ``MIN_RATIO`` (a prior of one secret in a thousand tokens).

Positions come from the texts between matches: ``split`` and ``regexp_extract_all`` walk a text alike, so
running sums of their code points are the starts and ends. Everything is one narrow pass that stages
spans, found strings and long tokens; counts of character pairs are grouped (at most 2 * 67^2 rows reach
the driver), and their ratios come back as a constant array. Hot sources and copies only meet in those
counts, which combine before the shuffle.

Defined cases: null text is empty and has no spans; null ids stay null; without samples of both kinds no
``markov`` spans are added; equal rows give equal rows; whole texts are scanned. The ordinary sample are
the tokens of about ``MAX_SAMPLE`` documents, those with the lowest hashes of their id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import register, staged, table

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = ("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                         for w in ASSIGN_WORDS)
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
MIN_VALUE = 6
#: Runs below the length fail, and no match can start inside a failed run, so the length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_TOKEN, MIN_RATIO = 20, math.log(1000)
TOKEN = "[A-Za-z0-9+/_=-]{%d,}"
#: Tokens of the ordinary sample.
SAMPLE_TOKEN = 8
MAX_SAMPLE = 4000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: the start, and any other character
#: Pseudo-counts of characters, and the weight of their shares in the pairs after a character.
SMOOTHING, BACK_OFF = 0.5, 20.0

_SPAN = "struct<start:bigint,end:bigint,value:string>"


def found(text: Column, pattern: str, present: Column, group: int = 0) -> Column:
    """Array of (start, end, value) of the matches; ``value`` is a group. ``present`` is a cheap test
    that holds whenever there is a match."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    start = F.struct(F.char_length(pieces[0]).cast("long").alias("at"), none.alias("out"))
    parts = F.zip_with(F.arrays_zip(whole.alias("m"), value.alias("v")),
                       F.slice(pieces, F.lit(2), F.size(pieces) - 1),
                       lambda mv, gap: F.struct(mv["m"].alias("m"), mv["v"].alias("v"),
                                                gap.alias("gap")))

    def step(acc, x):
        end = acc["at"] + F.char_length(x["m"])
        one = F.struct(acc["at"].alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.struct((end + F.char_length(x["gap"])).alias("at"),
                        F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(present, F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(none)


def scanned(docs: DataFrame, sample: float) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, assign, access, hex, long (tokens outside those) and words
    (tokens of sampled documents outside those)."""
    text = F.col("text")
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | \
        low.contains("api_key") | low.contains("apikey")
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id", "text",
        F.filter(found(text, ASSIGN, named, 2),
                 lambda s: F.char_length(s["value"]) >= MIN_VALUE).alias("assign"),
        found(text, ACCESS, text.contains("AKIA")).alias("access"),
        found(text, HEX, text.rlike(HEX)).alias("hex"))
    spans = F.concat("assign", "access", "hex")
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample * (1 << 30))

    def outside(tokens):
        return F.filter(tokens, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"])
                                                    & (t["start"] < s["end"])))

    token = TOKEN % MIN_TOKEN
    return base.withColumn("spans", spans).select(
        "doc_id", "assign", "access", "hex",
        outside(found(text, token, text.rlike(token))).alias("long"),
        F.transform(outside(found(text, TOKEN % SAMPLE_TOKEN, sampled)),
                    lambda t: t["value"]).alias("words"))


def state(token: Column, i: Column) -> Column:
    """State of the i-th character (from 1); 0 before the first."""
    return F.when(i < 1, 0).otherwise(F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """``tokens`` (random boolean, token) to counts of (random, pair), pair = before * STATES + here."""
    at = tokens.where(F.char_length("token") > 0).select(
        "random", "token", F.explode(F.sequence(F.lit(1), F.char_length("token"))).alias("i"))
    pair = state(F.col("token"), F.col("i") - 1) * STATES + state(F.col("token"), F.col("i"))
    return at.groupBy("random", pair.alias("pair")).agg(F.count("*").alias("n"))


def log_ratios(counts: list, back_off: float = BACK_OFF) -> list[float] | None:
    """Log of random over ordinary probability for each pair; None without both samples."""
    models = []
    for random in (True, False):
        own = {r["pair"]: r["n"] for r in counts if r["random"] == random}
        if not own:
            return None
        here, before = [SMOOTHING] * STATES, [back_off] * STATES
        for pair, n in own.items():
            here[pair % STATES] += n
            before[pair // STATES] += n
        total = sum(here)
        models.append([math.log((own.get(p, 0) + back_off * here[p % STATES] / total)
                                / before[p // STATES]) for p in range(STATES * STATES)])
    return [a - b for a, b in zip(*models)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token, random over ordinary."""
    table_ = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    return F.aggregate(F.sequence(F.lit(1), F.char_length(token)), F.lit(0.0), lambda a, i: a + F.get(
        table_, state(token, i - 1) * STATES + state(token, i)))


def scan(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and one array of (start, end, value) for each kind."""
    total = docs.count()
    rows = staged(scanned(docs, min(1.0, max_sample / max(1, total))), "secrets")
    random = rows.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(
        F.lit(True).alias("random"), F.col("s.value").alias("token"))
    plain = rows.select(F.explode("words").alias("token")).select(F.lit(False).alias("random"), "token")
    # Secrets among the sampled tokens would teach their own pairs, so characters alone sort them out.
    ratios = log_ratios(pair_counts(random.unionByName(plain)).collect(), 1e9)
    if ratios is not None:
        plain = plain.where(log_ratio(F.col("token"), ratios) <= 0)
        ratios = log_ratios(pair_counts(random.unionByName(plain)).collect())
    if ratios is None:
        return rows.select("doc_id", "assign", "access", "hex",
                           F.filter("long", lambda t: F.lit(False)).alias("markov"))
    return rows.select("doc_id", "assign", "access", "hex", F.filter("long", lambda t: (
        t["value"].rlike("[A-Za-z]")) & (log_ratio(t["value"], ratios) > MIN_RATIO)).alias("markov"))


def listed(kinds) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    spans = F.concat(*[_numbered(k, KINDS.index(k)) for k in kinds])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _numbered(kind: str, number: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"),
                                                s["end"].alias("end")))


@register("op1_secret_scan")
def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"),
                        listed(KINDS).alias("spans"), F.size("markov").cast("long").alias("n_markov"))
