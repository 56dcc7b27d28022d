import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from stavemill.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string"
TEXTS = st.text(st.sampled_from(list("<|\\!>endrolx é\n")), max_size=12)


def formatted(spark, rows):
    return C.format_chats(C.conversations(spark.createDataFrame(rows, ROWS)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=5), min_size=20, max_size=40))
def test_round_trip(spark, convs):
    rows = [(i, k, r, t) for i, c in enumerate(convs) for k, (r, t) in enumerate(c)]
    out = formatted(spark, rows).select("conv", "segments", "formatted", C.read_back(
        C.F.col("formatted")).alias("turns")).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == convs[r.conv]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|end|>") == len(convs[r.conv])


def test_machine_and_loss(spark):
    def chat(i, *roles):
        return [(i, k, r, f"{r}{k}") for k, r in enumerate(roles)]
    rows = (chat(1, "user", "assistant") + chat(2, "system", "user", "assistant", "user", "assistant")
            + chat(3, "user", "user", "assistant") + chat(4, "assistant") + chat(5, "user")
            + chat(6, "user", "system"))
    out = {r.conv: r for r in formatted(spark, rows).collect()}
    assert {i: (r.valid, r.bad_turn) for i, r in out.items()} == {
        1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 0), 5: (False, None), 6: (False, 1)}
    assert [s.text for s in out[2].segments if s.loss] == ["assistant2", "assistant4"]


def test_loss_is_read_from_the_output_by_the_mask(spark):
    rows = [(1, 0, "user", "<|end|>q"), (1, 1, "assistant", "<|end|>a\\"), (1, 2, "tool", "t"), (1, 3, "assistant", "b")]
    f = C.F
    out = formatted(spark, rows)
    assert out.select(C.read_loss(f.col("formatted"), f.col("segments"))).first()[0] == "<|end|>a\\b"
    # Other output or another mask: another loss.
    other = out.withColumn("formatted", f.replace("formatted", f.lit("b<|end|>"), f.lit("c<|end|>")))
    assert other.select(C.read_loss(f.col("formatted"), f.col("segments"))).first()[0] == "<|end|>a\\c"
    none = f.transform("segments", lambda s: f.struct(s["text"].alias("text"), f.lit(False).alias("loss")))
    assert out.select(C.read_loss(f.col("formatted"), none)).first()[0] == ""


def test_the_machine_runs_in_the_query(spark, folder):
    d = folder(conversations=spark.createDataFrame([(1, 0, "user", "a")], ROWS))
    out = C.op9_chat_formatting(spark, d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "assistant>user" in plan
    assert {(r.conv_id, r.valid, r.bad_turn) for r in out.collect()} == {(1, False, None), (-7, True, None)}


def test_defined_cases(spark):
    assert formatted(spark, []).count() == 0
    rows = [(None, 1, None, None), (None, None, "user", "x" * 300_000), (7, 0, "user", "a"),
            (7, 0, "user", "a"), (7, 0, "assistant", None)]
    out = {r.conv: [(t.role, t.text) for t in r.turns] for r in formatted(spark, rows).select(
        "conv", C.read_back(C.F.col("formatted")).alias("turns")).collect()}
    assert out == {None: [("user", "x" * 300_000), ("", "")],
                   7: [("assistant", ""), ("user", "a"), ("user", "a")]}


def test_templates_are_checked():
    with pytest.raises(ValueError):
        C.Template(close="</s>")
    with pytest.raises(ValueError):
        C.Template(close="<|a<|")
