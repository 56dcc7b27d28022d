"""Tokens to note events (N1-N10), score attributes and score documents.

The ordered tokens of a score are cut at its notes and rests, each stretch is folded to one event, and windows over
events carry marks, merge ties and compute beats: no window runs over tokens. All of it is keyed by ``score_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions.tokens import (TICKS_PER_QUARTER, duration_ticks_or_quarter, is_barline, is_chord,
                                is_note, is_rest, suffix)
from .sequence import flag, scaled_ticks

START_REPEAT, END_REPEAT = "barline-start-repeat", "barline-end-repeat"
TUPLET_MARKS = ("tuplet-3-start", "tuplet-3-end")


# What a token does, in one number: heads, tokens that attach to an open note, then marks, which all close it.
NOTE, REST, DUR, CHORD, DYNAMIC, TIE = range(1, 7)
STAFF_BASS, TUPLET_START, TUPLET_END, CLEF_F, CLEF_G, CLEF, START, BAR, END = range(7, 16)


def _kind(layout: bool) -> Column:
    """NULL for tokens that change nothing. Clefs are marks only in a layout, triplets only outside."""
    t = F.col("token")
    kind = (F.when(is_note(t), NOTE).when(is_rest(t), REST).when(t.startswith("dur-"), DUR)
            .when(is_chord(t), CHORD).when(t.startswith("dynamic-"), DYNAMIC).when(t == "tie", TIE)
            .when(t == "staff-bass", STAFF_BASS).when(t == START_REPEAT, START).when(t == END_REPEAT, END)
            .when(is_barline(t, "dataset"), BAR))
    if layout:
        return kind.when(t == "clef-F", CLEF_F).when(t == "clef-G", CLEF_G).when(t.startswith("clef-"), CLEF)
    return kind.when(t == TUPLET_MARKS[0], TUPLET_START).when(t == TUPLET_MARKS[1], TUPLET_END)


def _in_order(kind: Column) -> Column:
    """The tokens of a score that have a kind, by position."""
    return F.sort_array(F.collect_list(F.when(kind.isNotNull(), F.struct("pos", "token", kind.alias("kind")))))


# What the tokens of one stretch (a head and all up to the next) say. ``voice`` is the voice after the latest mark that
# sets it; ``ends`` and ``clef`` come before any such mark and belong to the voice the stretch begins in.
_STRETCH = {"is_open": "boolean", "dur": "string", "chord": "array<string>", "dynamic": "string", "tie": "boolean",
            "loose_ties": "int", "loose_dynamic": "string", "closers": "int", "bars": "int", "starts": "int",
            "triplet": "boolean", "voice": "string"}
_ENDS = {"ends": "int", "ends_bass": "int", "ends_treble": "int"}
_CLEFS = {"clef": "string", "clef_bass": "string", "clef_treble": "string"}
_START = {"int": 0, "boolean": False}


def _step(a: Column, x: Column, layout: bool) -> Column:
    """The next token of a stretch; what attaches to no open note is loose."""
    kind, token = x["kind"], x["token"]
    fields = (*_STRETCH, *(_CLEFS if layout else _ENDS))
    with_ = lambda **changed: F.struct(*[changed.get(f, a[f]).alias(f) for f in fields])
    count = lambda c, cond: a[c] + F.when(cond, 1).otherwise(0)
    set_ = lambda c, cond, value: F.when(cond, value).otherwise(a[c])
    head = with_(is_open=kind == NOTE, closers=count("closers", kind == REST))
    own = with_(dur=set_("dur", kind == DUR, token), dynamic=set_("dynamic", kind == DYNAMIC, token),
                chord=set_("chord", kind == CHORD, F.array_append(a["chord"], token)),
                tie=a["tie"] | (kind == TIE))
    loose = with_(loose_ties=count("loose_ties", kind == TIE),
                  loose_dynamic=set_("loose_dynamic", kind == DYNAMIC, token))
    # A barline belongs to the measure and voice it ends.
    bar = kind >= (START if layout else BAR)
    within = {"": a["voice"].isNull(), "_bass": a["voice"] == "bass", "_treble": a["voice"] == "treble"}
    if layout:
        clef = F.when(kind == CLEF_F, "bass").when(kind == CLEF_G, "treble")
        by_voice = {f"clef{v}": set_(f"clef{v}", cond & clef.isNotNull(), clef) for v, cond in within.items()}
    else:
        by_voice = {f"ends{v}": count(f"ends{v}", cond & (kind == END)) for v, cond in within.items()}
    mark = with_(is_open=F.lit(False), closers=a["closers"] + 1, bars=count("bars", bar),
                 starts=count("starts", kind == START),
                 triplet=F.when(kind == TUPLET_START, True).when(kind == TUPLET_END, False).otherwise(a["triplet"]),
                 voice=F.when(bar, "treble").when(kind == STAFF_BASS, "bass").otherwise(a["voice"]), **by_voice)
    return F.when(kind <= REST, head).when(kind > TIE, mark).when(a["is_open"], own).otherwise(loose)


HEAD_STATE = ("measure_idx", "run_idx", "voice", "in_tuplet", "start_marks")


def _events(tokens: DataFrame, layout: bool = False, forward_dynamics: bool = False,
            loose_ties: bool = False) -> DataFrame:
    """One row per note or rest with its last duration, chord tones and dynamic.

    The ordered tokens of a score are cut into stretches at the heads. Each is folded by itself, and windows over
    the stretches carry what marks change: measure, voice, open run and repeats, in a layout the clefs.
    """
    t = tokens.groupBy("score_id").agg(_in_order(_kind(layout)).alias("t"))
    t = t.withColumn("h", F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x["kind"] <= REST), i)),
                                   lambda i: i.isNotNull()))
    cut = F.transform("h", lambda lo, j: F.transform(
        F.sequence(lo, F.coalesce(F.get(F.col("h"), j + 1), F.size("t")) - 1), lambda i: F.get(F.col("t"), i)))
    ev = t.select("score_id", F.posexplode(cut).alias("event_idx", "t"))
    start = F.struct(*[(F.array() if kind == "array<string>" else F.lit(
        None if name in ("triplet", "voice") else _START.get(kind))).cast(kind).alias(name)
        for name, kind in (_STRETCH | (_CLEFS if layout else _ENDS)).items()])
    first = F.get("t", F.lit(0))
    ev = ev.select("score_id", "event_idx", first["pos"].alias("pos"),
                   F.when(first["kind"] <= REST, first["token"]).alias("head"),
                   F.aggregate("t", start, lambda a, x: _step(a, x, layout)).alias("s"))
    w = Window.partitionBy("score_id").orderBy("event_idx")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    rest = is_rest("head")
    ev = ev.select("score_id", "event_idx", "pos", "head", "s.*").select(
        "score_id", "event_idx", "pos", "head", "dur", "chord", "tie", rest.alias("is_rest"),
        *([F.lag("loose_dynamic").over(w).alias("carried")] if forward_dynamics else []),
        *([so_far("loose_ties").alias("ties_before")] if loose_ties else []), "dynamic",
        so_far("bars").cast("int").alias("measure_idx"), (so_far("closers") + flag(rest)).alias("run_idx"),
        F.coalesce(F.last("voice", True).over(earlier), F.lit("treble")).alias("voice"),
        F.coalesce(F.last("triplet", True).over(earlier), F.lit(False)).alias("in_tuplet"),
        so_far("starts").alias("start_marks"),
        *[F.col(c).alias(f"_{c}") for c in (_CLEFS if layout else _ENDS)])
    for v in ("bass", "treble"):
        here = F.col("voice") == v
        ev = ev.withColumn(f"_{v}", F.coalesce(f"_clef_{v}", F.when(here, F.col("_clef"))) if layout
                           else F.col(f"_ends_{v}") + F.when(here, F.col("_ends")).otherwise(0))
    if layout:
        ev = ev.withColumns({f"clef_{v}": F.last(f"_{v}", True).over(earlier) for v in ("bass", "treble")})
    else:
        everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ev = ev.withColumns({f"ends_{v}": so_far(f"_{v}") for v in ("bass", "treble")}
                            | {f"all_ends_{v}": F.sum(f"_{v}").over(everything) for v in ("bass", "treble")})
    dynamic = F.col("dynamic")
    if forward_dynamics:
        dynamic = F.coalesce(dynamic, F.when(~rest, F.col("carried")))
    more = [c for c in ev.columns if c.startswith(("clef_", "ends_", "all_ends_", "ties_before"))]
    return ev.filter("head IS NOT NULL").select(
        "score_id", "event_idx", "pos", "head", *HEAD_STATE, *more, "is_rest", "chord",
        suffix(dynamic, "dynamic-").alias("dynamic"), "tie",
        F.when(rest, "").otherwise(P.normalize_pitch(suffix("head", "note-"))).alias("pitch"),
        duration_ticks_or_quarter(F.when(rest, F.col("head")).otherwise(F.col("dur"))).alias("own_ticks"))


def note_events(tokens: DataFrame) -> DataFrame:
    """Notes and rests before tie merging: ``head`` token, spelling, length and chord tokens."""
    ev = _events(tokens)
    return ev.select("score_id", "event_idx", "pos", "voice", "measure_idx", "head", "is_rest",
                     "pitch", F.col("own_ticks").alias("ticks"),
                     F.transform("chord", lambda c: suffix(c, "chord-")).alias("chord"))


def _merge_ties(events: DataFrame, compat: bool) -> DataFrame:
    """Equal pitches joined by a tie inside one open run become one event."""
    w = Window.partitionBy("score_id").orderBy("event_idx")
    prev = lambda c: F.lag(c).over(w)
    joined = (~F.col("is_rest") & (prev("run_idx") == F.col("run_idx"))
              & ~prev("is_rest") & (prev("pitch") == F.col("pitch")))
    tied = prev("tie")
    if compat:
        # A tie seen with no open note stays armed and joins the next two equal notes.
        notes_before = F.last(F.when(~F.col("is_rest"), F.col("ties_before")), True).over(
            w.rowsBetween(Window.unboundedPreceding, -1))
        events = events.withColumn(
            "armed", F.col("ties_before") > F.coalesce(notes_before, F.lit(0)))
        tied = tied | prev("armed")
    df = events.withColumn("starts", flag(~F.coalesce(joined & tied, F.lit(False))))
    df = df.withColumn("chain", F.sum("starts").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marks = [c for c in events.columns if c.startswith(("clef_", "ends_", "all_ends_"))]
    first = F.struct("pos", "pitch", "is_rest", *HEAD_STATE, *marks)
    last_dynamic = F.max(F.when(F.col("dynamic").isNotNull(), F.struct("event_idx", "dynamic")))
    return df.groupBy("score_id", "chain").agg(
        F.min_by(first, "event_idx").alias("f"),
        F.sum("own_ticks").cast("int").alias("raw_ticks"),
        F.max_by("chord", "event_idx").alias("chord_rows"),
        last_dynamic["dynamic"].alias("dynamic")).select(
        "score_id", "chain", "f.*", "raw_ticks", "chord_rows", "dynamic")


def tokens_to_notes(tokens: DataFrame, compat: bool = False, dynamics: str = "attached"
                    ) -> DataFrame:
    """``(score_id, staff, note_idx, measure_idx, pitch, ticks, beat, chord, is_rest, dynamic,
    repeat, tuplet)``.

    ``compat`` reproduces the leaking tie flag; ``dynamics="forward"`` gives a dynamic written
    before a note to that note instead of dropping it.
    """
    events = _events(tokens, False, dynamics == "forward", compat)
    ch = _merge_ties(events, compat)
    w = Window.partitionBy("score_id").orderBy("chain")
    wv = Window.partitionBy("score_id", "voice").orderBy("chain")
    own = lambda kind: F.when(F.col("voice") == "bass", F.col(f"{kind}_bass")).otherwise(
        F.col(f"{kind}_treble"))
    ch = ch.withColumn("ticks", scaled_ticks(F.col("raw_ticks"), F.col("in_tuplet")))
    quarters = F.bround(F.col("ticks") / float(TICKS_PER_QUARTER), 0).cast("int")
    ch = ch.select(
        "*",
        F.greatest(F.lit(1), F.least(F.lit(4), quarters)).alias("advance"),
        # A start mark goes to the next event of any voice ...
        (F.col("start_marks") > F.coalesce(F.lag("start_marks").over(w), F.lit(0)))
        .alias("starts_repeat"),
        # ... an end mark to the latest event of the voice it closes.
        (F.coalesce(F.lead(own("ends")).over(wv), own("all_ends")) > own("ends"))
        .alias("ends_repeat"))
    wm = (Window.partitionBy("score_id", "voice", "measure_idx").orderBy("chain")
          .rowsBetween(Window.unboundedPreceding, -1))
    beat = F.coalesce(F.sum("advance").over(wm), F.lit(0)) % 4 + 1
    return ch.select(
        "score_id", "voice", "chain", "measure_idx", "pitch", "ticks", "is_rest", "dynamic",
        beat.cast("int").alias("beat"),
        F.transform("chord_rows", lambda c: P.normalize_pitch(suffix(c, "chord-")))
        .alias("chord"),
        F.when(F.col("ends_repeat"), "end-repeat").when(F.col("starts_repeat"), "start-repeat")
        .alias("repeat"),
        F.col("in_tuplet").alias("tuplet"),
        (F.row_number().over(wv) - 1).alias("note_idx")).select(
        "score_id", F.col("voice").alias("staff"), "note_idx", "measure_idx", "pitch", "ticks",
        "beat", "chord", "is_rest", "dynamic", "repeat", "tuplet")


def tokens_to_layout_notes(tokens: DataFrame) -> DataFrame:
    """The drawing variant: clef on every note, ``measure_start``, no tuplets or beats."""
    ch = _merge_ties(_events(tokens, layout=True), compat=False)
    wv = Window.partitionBy("score_id", "voice").orderBy("chain")
    clef = F.when(F.col("voice") == "bass", F.coalesce("clef_bass", F.lit("bass"))).otherwise(
        F.coalesce("clef_treble", F.lit("treble")))
    prev = F.lag("measure_idx").over(wv)
    return ch.select(
        "score_id", F.col("voice").alias("staff"),
        (F.row_number().over(wv) - 1).alias("note_idx"), "pitch",
        F.col("raw_ticks").alias("ticks"),
        F.transform("chord_rows", lambda c: P.normalize_pitch(suffix(c, "chord-")))
        .alias("chord"),
        "is_rest", clef.alias("clef"),
        (prev.isNull() | (prev != F.col("measure_idx"))).alias("measure_start"))


def score_attributes(tokens: DataFrame) -> DataFrame:
    """``(score_id, time_num, time_den, clef_upper, clef_lower)``; the last mark wins."""
    t = F.col("token")
    pat = r"^time-([0-9]+)/([0-9]+)$"
    kind = (F.when(t == "staff-bass", STAFF_BASS).when(is_barline(t, "notes"), BAR).when(t == "clef-F", CLEF_F)
            .when(t.startswith("clef-"), CLEF).when(t.rlike(pat), START))
    none = F.lit(None).cast("string")

    def step(a: Column, x: Column) -> Column:
        k = x["kind"]
        clef = F.when(k == CLEF_F, "bass").when(k == CLEF, "treble")
        return F.struct(
            F.when(k == STAFF_BASS, True).when(k == BAR, False).otherwise(a["bass"]).alias("bass"),
            F.when(k == START, x["token"]).otherwise(a["t"]).alias("t"),
            F.coalesce(F.when(~a["bass"], clef), a["u"]).alias("u"),
            F.coalesce(F.when(a["bass"], clef), a["l"]).alias("l"))

    start = F.struct(F.lit(False).alias("bass"), none.alias("t"), none.alias("u"), none.alias("l"))
    return tokens.groupBy("score_id").agg(F.aggregate(_in_order(kind), start, step).alias("s")).select(
        "score_id", "s.*").select(
        "score_id",
        F.coalesce(F.regexp_extract("t", pat, 1).cast("int"), F.lit(4)).alias("time_num"),
        F.coalesce(F.regexp_extract("t", pat, 2).cast("int"), F.lit(4)).alias("time_den"),
        F.coalesce("u", F.lit("treble")).alias("clef_upper"),
        F.coalesce("l", F.lit("bass")).alias("clef_lower"))


def with_staff_clef(notes: DataFrame, attributes: DataFrame) -> DataFrame:
    """``clef`` becomes the note's own clef or, without one, its staff's."""
    staff_clef = F.when(F.col("staff") == "bass", F.col("clef_lower")).otherwise(
        F.col("clef_upper"))
    own = F.col("clef") if "clef" in notes.columns else F.lit(None).cast("string")
    return (notes.join(attributes.select("score_id", "clef_upper", "clef_lower"), "score_id")
            .withColumn("staff_clef", staff_clef)
            .withColumn("clef", F.coalesce(own, staff_clef)).drop("clef_upper", "clef_lower"))


def mixed_clef(notes: DataFrame) -> DataFrame:
    """Staves that hold more than one effective clef."""
    return notes.groupBy("score_id", "staff").agg(
        (F.min("clef") != F.max("clef")).alias("has_mixed_clef"))


_NOTE = ("struct<pitch:string,duration:double,beat:int,chordNotes:array<string>,isRest:boolean,"
         "dynamicMark:string,repeatMark:string,tuplet:boolean>")
DOCUMENT = (f"id string, title string, tempo int, timeSignature array<int>, createdAt bigint, "
            f"staves array<struct<clef:string,notes:array<{_NOTE}>>>, notes array<{_NOTE}>")


def to_score_document(notes: DataFrame, attributes: DataFrame, meta: DataFrame | None = None,
                      tempo: int = 100) -> DataFrame:
    """One JSON document per score; a lower staff adds ``staves`` and ``notes`` is the upper.
    ``meta(score_id, title, created_at)`` adds a title and the creation time in milliseconds.

    All inputs are keyed by ``score_id``; the lists hold one score's notes.
    """
    null_if = lambda cond, c: F.when(cond, F.col(c))
    note = F.struct(
        F.col("pitch"), (F.col("ticks") / float(TICKS_PER_QUARTER)).alias("duration"), F.col("beat"),
        null_if(F.size("chord") > 0, "chord").alias("chordNotes"),
        null_if(F.col("is_rest"), "is_rest").alias("isRest"),
        F.col("dynamic").alias("dynamicMark"), F.col("repeat").alias("repeatMark"),
        null_if(F.col("tuplet"), "tuplet").alias("tuplet"))
    listed = lambda staff: F.transform(F.sort_array(F.collect_list(
        F.when(F.col("staff") == staff, F.struct(F.col("note_idx"), note.alias("n"))))),
        lambda x: x["n"])
    per = notes.groupBy("score_id").agg(listed("treble").alias("upper"),
                                        listed("bass").alias("lower"))
    df = per.join(attributes, "score_id")
    df = df.join(meta.select("score_id", "title", "created_at"), "score_id", "left") if meta is not None \
        else df.withColumns({"title": F.lit(None).cast("string"), "created_at": F.lit(None).cast("bigint")})
    staves = F.when(F.size("lower") > 0, F.array(
        F.struct(F.col("clef_upper").alias("clef"), F.col("upper").alias("notes")),
        F.struct(F.col("clef_lower").alias("clef"), F.col("lower").alias("notes"))))
    return df.select("score_id", F.to_json(F.struct(
        F.col("score_id").cast("string").alias("id"), "title",
        F.lit(tempo).alias("tempo"), F.array("time_num", "time_den").alias("timeSignature"),
        F.col("created_at").alias("createdAt"), staves.alias("staves"), F.col("upper").alias("notes"))).alias("document"))


def read_score_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """JSON documents to note rows with their score's id, title, creation time, tempo and time
    signature. Without ``staves`` the notes are the upper staff."""
    j = documents.select(F.from_json(column, DOCUMENT).alias("j")).select("j.*")
    upper = F.array(F.struct(F.lit("treble").alias("clef"), F.col("notes").alias("notes")))
    rows = j.select(
        "id", "title", F.col("createdAt").alias("created_at"), "tempo",
        F.get("timeSignature", F.lit(0)).alias("time_num"), F.get("timeSignature", F.lit(1)).alias("time_den"),
        F.posexplode(F.coalesce("staves", upper)).alias("s", "part"))
    rows = rows.select("id", "title", "created_at", "tempo", "time_num", "time_den", "s",
                       F.col("part.clef").alias("staff_clef"), F.posexplode("part.notes").alias("note_idx", "n"))
    return rows.select(
        "id", "title", "created_at", "tempo", "time_num", "time_den",
        F.when(F.col("s") == 0, "treble").otherwise("bass").alias("staff"), "staff_clef", "note_idx", "n.pitch", F.round(F.col("n.duration") * TICKS_PER_QUARTER).cast("bigint").alias("ticks"),
        "n.beat", F.coalesce("n.chordNotes", F.array().cast("array<string>")).alias("chord"),
        F.coalesce("n.isRest", F.lit(False)).alias("is_rest"), F.col("n.dynamicMark").alias("dynamic"),
        F.col("n.repeatMark").alias("repeat"), F.coalesce("n.tuplet", F.lit(False)).alias("tuplet"))
