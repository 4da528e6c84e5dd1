"""The staged program and its switches, on a few questions."""

import pytest

from veritrail.operators import staged

QUESTIONS = [("1", "What connects Alpha and Beta?"), ("2", "Where is Gamma near Alpha?"), ("3", "Who made Delta?"), ("4", None), ("5", "Is Alpha near Beta?")]
TRIPLES = [("Alpha", "bridge", "Beta"), ("Beta", "near", "Omega")]
PASSAGES = [("1", "Alpha meets Beta at noon."), ("2", "Gamma lies near Alpha. It rains."), ("3", "Delta was made by Ann. It is large."), ("9", "Nobody asks.")]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(QUESTIONS, "qid string, question string"), spark.createDataFrame(TRIPLES, "h string, r string, t string"), spark.createDataFrame(PASSAGES, "qid string, passage string")


def ran(frames, **how):
    return {r["qid"]: r for r in staged.run(*frames, **how).collect()}


def test_full(frames):
    got = ran(frames)
    assert set(got) == {"1", "2", "3", "4", "5"}
    assert (got["1"]["gap"], got["1"]["repair_steps"], got["1"]["fallback_steps"]) == ("complete", "", "")
    # Gamma is missing from the graph; its passage gives a triple.
    assert (got["2"]["gap"], got["2"]["missing"], got["2"]["repair_steps"]) == ("complete", "", "passage_repair")
    assert (got["3"]["fallback_steps"], got["3"]["answer"], got["3"]["missing"]) == ("no_triples_fallback", "Delta was made by Ann.", "delta")
    assert got["4"]["answer"] == "unknown" and got["4"]["fallback_steps"] == "no_triples_fallback"


def test_without_verification_nothing_is_checked_or_repaired(frames):
    for how in ({"ablation": "without_verification"}, {"mode": "no_verif"}):
        got = ran(frames, **how)
        assert all((r["gap"], r["missing"], r["repair_steps"]) == ("unchecked", "", "") and r["verification_disabled"] and r["repair_disabled"] for r in got.values())


def test_without_repair_gaps_stay(frames):
    got = ran(frames, ablation="without_repair")
    assert (got["2"]["gap"], got["2"]["missing"], got["2"]["repair_steps"], got["2"]["repair_disabled"]) == ("missing_entities", "gamma", "", True)
    assert not got["2"]["verification_disabled"]


def test_without_reader_context_passages_are_not_read(frames):
    got = ran(frames, ablation="without_reader_context")
    assert got["1"]["answer"] == "Alpha bridge Beta." and got["1"]["reader_context_disabled"] and not got["1"]["refinement_used"]
    assert ran(frames)["1"]["reader_context_disabled"] is False


def test_refinement_takes_what_passages_say(frames):
    reader = lambda q, e: __import__("pandas").DataFrame({"answer": ["-" if "bridge" in (x or "") else (x or "unknown") for x in e], "confidence": 0.5})
    got = ran(frames, reader=reader)
    assert got["1"]["answer"] == "Alpha meets Beta at noon." and got["1"]["refinement_used"]
    got = ran(frames, reader=reader, ablation="without_answer_refinement")
    assert got["1"]["answer"] == "-" and not got["1"]["refinement_used"]


def test_no_decomp_asks_the_whole_question(spark):
    asked = spark.createDataFrame(QUESTIONS[:1], "qid string, question string")
    assert [r["subquery"] for r in staged.decomposed(asked, "no_decomp").collect()] == [QUESTIONS[0][1]]
    assert [r["subquery"] for r in staged.decomposed(asked).orderBy("place").collect()] == ["What connects Alpha", "Beta"]


def test_unknown_modes_and_ablations(frames):
    with pytest.raises(ValueError):
        staged.run(*frames, mode="fast")
    with pytest.raises(ValueError):
        staged.run(*frames, ablation="without_everything")
