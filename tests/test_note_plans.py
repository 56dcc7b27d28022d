"""Note events are derived without windows over tokens; what marks change still reaches every event."""

from stavemill.operators import notes as N

from .conftest import token_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _windows(df) -> list[str]:
    return [x for x in _plan(df).split("\n") if "Window [" in x]


def test_no_window_or_sort_over_tokens(spark):
    t = token_table(spark, {1: "clef-G note-C4 dur-1/4 barline"})
    assert not _windows(N.score_attributes(t))
    for df in (N.tokens_to_notes(t), N.tokens_to_notes(t, True, "forward"), N.tokens_to_layout_notes(t),
               N.note_events(t)):
        assert _windows(df) and not any("token" in x or "pos#" in x.split("windowspec")[1] for x in _windows(df))
        assert not any("pos#" in x for x in _plan(df).split("\n") if "Sort [" in x)


def test_marks_before_between_and_after_heads(spark):
    t = token_table(spark, {
        1: "staff-bass clef-G tuplet-3-start note-C4 dur-1/8 barline-end-repeat barline-start-repeat note-Db4 dur-x "
           "dynamic-p chord-Eb4 chord-C4 tie staff-bass clef-F tuplet-3-end rest-1/2 dynamic-f note-C3 barline-end-repeat",
        2: "clef-F barline time-3/4 staff-bass clef-G",
        3: "slur-start"})
    got = [(r.staff, r.note_idx, r.measure_idx, r.pitch, r.ticks, r.chord, r.dynamic, r["repeat"], r.tuplet)
           for r in N.tokens_to_notes(t, dynamics="forward").orderBy("staff", "note_idx").collect()]
    assert got == [
        ("bass", 0, 0, "C4", 8, [], None, "end-repeat", True),
        ("bass", 1, 1, "", 48, [], None, None, False),
        ("bass", 2, 1, "C3", 24, [], "f", "end-repeat", False),
        ("treble", 0, 1, "C#4", 16, ["D#4", "C4"], "p", "start-repeat", True)]
    clefs = [(r.staff, r.pitch, r.clef) for r in N.tokens_to_layout_notes(t).orderBy("staff", "note_idx").collect()]
    assert clefs == [("bass", "C4", "treble"), ("bass", "", "bass"), ("bass", "C3", "bass"), ("treble", "C#4", "treble")]
    assert {r.score_id: tuple(r)[1:] for r in N.score_attributes(t).collect()} == {
        1: (4, 4, "treble", "bass"), 2: (3, 4, "bass", "treble"), 3: (4, 4, "treble", "bass")}
