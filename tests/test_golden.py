"""Hand-written sequences, one rule each."""

import json

import pytest

from stavemill.functions import vocab
from stavemill.operators import notes as N
from stavemill.operators import practice as PR
from stavemill.operators import repair as R
from stavemill.operators import sequence as S
from stavemill.sources import performances as PF
from stavemill.streaming import folds as FO
from tests.conftest import sequences, token_table


def notes(spark, text, **kw):
    rows = N.tokens_to_notes(token_table(spark, {1: text}), **kw).collect()
    return sorted(rows, key=lambda r: (r.staff != "treble", r.note_idx))


def test_vocabulary():
    v = vocab.vocabulary()
    assert len(v) == len(set(v)) == 259
    assert (v.index("<UNK>"), v.index("note-C2"), v.index("dur-1/1"), v.index("tie")) == (3, 28, 113, 258)


def test_tie_across_a_barline_stays_two_notes(spark):
    n = notes(spark, "note-C4 dur-1/4 tie barline note-C4 dur-1/4")
    assert [(x.pitch, x.ticks, x.beat) for x in n] == [("C4", 24, 1), ("C4", 24, 1)]


def test_tie_merges_enharmonic_spellings_and_keeps_the_last_chord(spark):
    n = notes(spark, "note-Db4 dur-1/4 chord-F4 dynamic-p tie note-C#4 dur-1/8 chord-Ab4")
    assert [(x.pitch, x.ticks, x.chord, x.dynamic) for x in n] == [("C#4", 36, ["G#4"], "p")]


def test_loose_tie_leaks_only_in_the_compatible_mode(spark):
    text = "tie note-C4 dur-1/4 note-C4 dur-1/4"
    assert [x.ticks for x in notes(spark, text)] == [24, 24]
    assert [x.ticks for x in notes(spark, text, compat=True)] == [48]


def test_triplet_with_a_rest(spark):
    n = notes(spark, "tuplet-3-start note-C4 dur-1/8 rest-1/8 note-E4 dur-1/8 tuplet-3-end note-F4 dur-1/4")
    assert [(x.ticks, x.tuplet, x.is_rest) for x in n] == [
        (8, True, False), (8, True, True), (8, True, False), (24, False, False)]


def test_repeat_marks(spark):
    n = notes(spark, "barline-end-repeat note-C4 dur-1/4 staff-bass barline-start-repeat note-D3 dur-1/4 "
                     "staff-bass note-E3 dur-1/4 barline-end-repeat note-F4 dur-1/4")
    got = {(x.staff, x.pitch): x.repeat for x in n}
    assert got == {("treble", "C4"): None, ("bass", "D3"): "start-repeat",
                   ("bass", "E3"): "end-repeat", ("treble", "F4"): None}


def test_malformed_durations_count_a_quarter(spark):
    assert [x.ticks for x in notes(spark, "note-C4 dur-x note-D4 dur-1/0 note-E4")] == [24, 24, 24]


def test_half_quarters_round_to_even(spark):
    # 2.5 quarters advance two beats, 3.5 advance four.
    n = notes(spark, "note-C4 dur-5/8 note-D4 dur-7/8 note-E4 dur-1/4")
    assert [x.beat for x in n] == [1, 3, 3]


def test_dynamics_before_a_note(spark):
    text = "dynamic-f note-C4 dur-1/4"
    assert notes(spark, text)[0].dynamic is None
    assert notes(spark, text, dynamics="forward")[0].dynamic == "f"


def test_attributes_and_document(spark):
    t = token_table(spark, {1: "time-12/8 clef-G note-C4 dur-1/4 staff-bass clef-G note-C3 barline",
                            2: "note-C4 dur-1/8"})
    a = {r.score_id: tuple(r)[1:] for r in N.score_attributes(t).collect()}
    assert a == {1: (12, 8, "treble", "treble"), 2: (4, 4, "treble", "bass")}
    docs = {r.score_id: json.loads(r.document) for r in
            N.to_score_document(N.tokens_to_notes(t), N.score_attributes(t)).collect()}
    assert [s["clef"] for s in docs[1]["staves"]] == ["treble", "treble"]
    assert docs[1]["notes"] == docs[1]["staves"][0]["notes"]
    assert "staves" not in docs[2] and docs[2]["notes"] == [{"pitch": "C4", "duration": 0.5, "beat": 1}]


@pytest.mark.parametrize("body,want", [
    ("note-C4 dur-1/4 note-C4 dur-1/4 note-C4 dur-1/4 barline", "time-3/4"),
    ("note-C4 dur-1/8 note-C4 dur-1/8 note-C4 dur-1/2 barline", "time-6/8"),
    ("note-C4 dur-1/2 barline note-C4 dur-1/1 barline note-C4 dur-1/1 barline", "time-4/4"),
    ("note-C4 dur-1/2 barline note-C4 dur-1/1 barline", "time-2/4"),
    ("note-C4 dur-3/8 barline", "time-5/4"),
    ("note-C4 dur-1/1", "time-5/4")])
def test_time_signature_vote(spark, body, want):
    got = sequences(R.fix_time_signature(token_table(spark, {1: "clef-G key-C time-5/4 " + body})))[1]
    assert got[2] == want and len(got) == len(body.split()) + 3


def test_accidentals(spark):
    t = token_table(spark, {1: "key-A note-C4 chord-F9 note-G4 note-Fb4 note-B4", 2: "note-C4",
                            3: "key-F# note-E4"})
    got = sequences(R.fix_accidentals(t))
    assert got == {1: ["key-A", "note-C#4", "chord-F9", "note-G#4", "note-Fb4", "note-B4"],
                   2: ["note-C4"], 3: ["key-F#", "note-E4"]}


def test_orphan_chord_after_rest(spark):
    t = token_table(spark, {1: "chord-C4 rest-1/4 chord-C4 note-D4 dur-1/4 chord-E4 chord-G4 fermata chord-A4"})
    assert sequences(R.drop_orphan_chords(t))[1] == [
        "rest-1/4", "note-D4", "dur-1/4", "chord-E4", "chord-G4", "fermata"]


def test_header_stripping_needs_the_order(spark):
    t = token_table(spark, {1: "clef-G key-C time-4/4 note-C4", 2: "key-C time-4/4", 3: "clef-F time-4/4",
                            4: "clef-C key-C"})
    assert sequences(S.strip_leading_header(t)) == {
        1: ["note-C4"], 2: ["key-C", "time-4/4"], 3: ["time-4/4"], 4: ["clef-C", "key-C"]}


def test_split_uses_breaks_only_when_they_fit(spark):
    from pyspark.sql import functions as F
    t = token_table(spark, {1: "clef-G note-C4 barline note-D4 barline note-E4 barline"})
    t = t.withColumn("n_systems", F.lit(2))
    part = lambda b: sequences(S.split_systems(t.withColumn("breaks", F.array(*map(F.lit, b))))
                               .filter("system_idx = 0"))[1].count("barline")
    assert (part([2]), part([1]), part([3]), part([1, 2])) == (2, 1, 1, 1)


def test_voice_pairs(spark):
    from pyspark.sql import functions as F
    t = token_table(spark, {1: "clef-G note-C5 staff-bass clef-F note-C3 barline note-D5 barline note-E5"})
    p = S.split_voice_pairs(t.withColumn("n_systems", F.lit(1)))
    assert sequences(p.filter("voice = 'treble'"))[1] == [
        "clef-G", "note-C5", "barline", "note-D5", "barline", "note-E5", "barline-final"]
    assert sequences(p.filter("voice = 'bass'"))[1] == ["<SOS>", "clef-F", "note-C3", "barline"]


def step(*pitches, beat=1):
    return {"beat": beat, "pitches": list(pitches)}


def play(spark, mode, *cases):
    """(plan, script) pairs, each a session, to (correct, wrong, done)."""
    import json
    rows = []
    for i, (plan, script) in enumerate(cases):
        rows.append((i, 0, "start", None, json.dumps(plan)))
        for k, move in enumerate(script.split()):
            kind, pitch = ("off", move[1:]) if move[0] == "-" else ("on", move)
            rows.append((i, k + 1, kind, pitch, None))
    df = PF.started(spark.createDataFrame(
        rows, "session_id bigint, seq bigint, kind string, pitch string, plan string"))
    got = FO.grades(df.repartition(3), mode).orderBy("session_id").collect()
    return [(r.correct, r.wrong, r.done) for r in got]


def test_grading_scripts(spark):
    both = {"both": True, "midi": True, "t": [[step("E4", "G4"), step("A4", beat=2)]],
            "b": [[step("C3"), step("D3", beat=3)]]}
    shared = {"both": True, "midi": True, "t": [[step("C4")]], "b": [[step("C4")]]}
    touch = {"both": False, "midi": False, "t": [[step("C4", "E4")], [step("D4")]], "b": []}
    gap = {"both": False, "midi": True, "t": [[step("C4")], [], [step("D4")]], "b": []}
    twice = {"both": False, "midi": True, "t": [[step("C4", "C4"), step("D4")]], "b": []}
    got = play(
        spark, "performance",
        # Same beat: all tones of both hands must be down together.
        (both, "E4 G4 C3 A4 D3"), (both, "E4 -E4 G4 C3"), (both, "E4 -E4 G4 C3 E4 A4 D3"), (both, "C9 E4 G4 C3"),
        # A tone both hands need counts twice.
        (shared, "C4"),
        # Touch input: the highest tone passes a chord, the others do nothing.
        (touch, "C4 E4 D4 D4"),
        # An empty measure passes by itself; equal tones of a step count once.
        (gap, "C4 D4"), (twice, "C4 D4"), (both, ""))
    assert got == [(5, 0, True), (0, 0, False), (5, 0, True), (3, 1, False), (2, 0, True), (3, 0, True),
                   (2, 0, True), (2, 0, True), (0, 0, False)]


def test_press_marks(spark):
    both = {"both": True, "midi": True, "t": [[step("E4", "G4")]], "b": [[step("C3")]]}
    import json
    rows = [(1, 0, "start", None, json.dumps(both))] + [
        (1, i + 1, "off" if k[0] == "-" else "on", k.strip("-"), None)
        for i, k in enumerate("E4 D4 -D4 G4 C3 C3".split())]
    df = PF.started(spark.createDataFrame(
        rows, "session_id bigint, seq bigint, kind string, pitch string, plan string"))
    assert [(r.seq, r.mark) for r in FO.press_marks(df).orderBy("seq").collect()] == [
        (1, "wait"), (2, "wrong"), (4, "wait"), (5, "hit")]


def test_quiz_and_wait_scripts(spark):
    quiz = lambda m: {"mode": m, "notes": ["C4", "E4"]}
    assert play(spark, "quiz", (quiz("note"), "D4 C4 C4"), (quiz("chord"), "C4 D4 E4"),
                (quiz("chord"), "C4 D4 E4 C4"), (quiz("sequence"), "C4 D4 E4")) == [
        (1, 1, True), (2, 1, False), (3, 1, True), (2, 1, True)]
    assert play(spark, "wait", ({"notes": ["C4", "E4"]}, "E4 C4 C4 E4")) == [(2, 2, True)]


def test_final_score_rounds_halves_up(spark):
    from pyspark.sql import functions as F
    rows = [(1, 7, 100, False, True), (0, 0, 100, False, True), (1, 15, 150, True, True), (3, 0, 100, False, False)]
    df = spark.createDataFrame(rows, "c int, w int, m int, h boolean, r boolean")
    got = [r.s for r in df.select(PR.final_score(*[F.col(x) for x in "cwmhr"]).alias("s")).collect()]
    assert got == [12.5, 0.0, 0.0, None]


def test_rests_keep_hands_aligned(spark):
    t = token_table(spark, {1: "rest-1/1 staff-bass note-C3 dur-1/1 barline note-C5 dur-1/1 staff-bass "
                               "note-D3 dur-1/1 barline"})
    n = N.tokens_to_notes(t)
    place = lambda df: {(r.staff, r.pitches[0]): r.measure for r in df.collect()}
    assert place(PR.performance_steps(n)) == {("bass", "C3"): 0, ("bass", "D3"): 1, ("treble", "C5"): 1}
    assert place(PR.performance_steps(n, compat=True))[("treble", "C5")] == 0
