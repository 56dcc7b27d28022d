"""The fold of a session evaluates every value once and keeps marks only where they are asked for."""

from stavemill.sources import performances as PF
from stavemill.streaming import folds as FO

PLAN = ('{"both":true,"midi":true,"t":[[{"beat":1,"pitches":["C4","E4"]}],[{"beat":1,"pitches":["D4"]}]],'
        '"b":[[{"beat":1,"pitches":["C3"]}],[]]}')


def session(spark, *keys):
    rows = [(1, 0, "start", None, PLAN, None)] + [(1, i, k, p, None, None) for i, (k, p) in enumerate(keys, 1)]
    return spark.createDataFrame(rows, PF.MESSAGE_SCHEMA)


def test_values_of_a_press_are_computed_once(spark):
    messages = session(spark, ("on", "C4"))
    text = FO.grades(messages, "performance")._jdf.queryExecution().analyzed().toString()
    assert text.count("array_union(") == 1 and text.count("array_except(") == 1


def test_marks_and_totals_of_a_session(spark):
    messages = session(spark, ("on", "C4"), ("on", "A4"), ("off", "A4"), ("on", "E4"), ("on", "C3"), ("on", "D4"),
                       ("on", "D4"))
    assert [tuple(r) for r in FO.grades(messages, "performance").collect()] == [(1, 8, 4, 1, True)]
    marks = {r.seq: (r.pitch, r.mark) for r in FO.press_marks(messages).collect()}
    assert marks == {1: ("C4", "wait"), 2: ("A4", "wrong"), 4: ("E4", "wait"), 5: ("C3", "hit"), 6: ("D4", "hit")}
    silent = session(spark)
    assert FO.press_marks(silent).count() == 0
    assert [tuple(r) for r in FO.grades(silent, "performance").collect()] == [(1, 1, 0, 0, False)]
