"""Input and output pairs of the text kernel and the classifiers."""

import pytest
from pyspark.sql import functions as F

from veritrail.functions import classify as c
from veritrail.functions import text as t
from veritrail.functions.dialect import SPARK as d


def value(spark, expression, **columns):
    df = spark.range(1)
    for name, x in columns.items():
        df = df.withColumn(name, F.lit(x))
    return df.selectExpr(f"{expression} AS v").first()["v"]


@pytest.mark.parametrize(("x", "want"), [("The Straight Story", "straight story"), ("St. Elizabeths Hospital", "st elizabeths hospital"), ("", "")])
def test_entity_name(spark, x, want):
    assert value(spark, t.entity_name(d, "x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("The EGOT.", "egot"), ("a  b, the c", "b c"), ("An a", "")])
def test_normalized(spark, x, want):
    assert value(spark, t.normalized(d, "x"), x=x) == want


@pytest.mark.parametrize(("p", "g", "em", "f1"), [("The EGOT.", "EGOT", 1, 1.0), ("wrong", "right answer", 0, 0.0), ("right", "right answer", 0, 0.6667), ("", "", 1, 0.0)])
def test_scores(spark, p, g, em, f1):
    assert value(spark, t.exact(d, "p", "g"), p=p, g=g) == em
    assert value(spark, t.f1(d, t.tokens(d, "p"), t.tokens(d, "g")), p=p, g=g) == f1


@pytest.mark.parametrize("x", ["", "Unknown", "Passage [8] gives full name", "But per instructions"])
def test_bad_evaluation(spark, x):
    assert value(spark, t.bad_evaluation(d, "x"), x=x)


@pytest.mark.parametrize("x", ["Looking again", "Re-read", "Wait", "FINAL ANSWER", "member of the", "a --> b"])
def test_bad_pipeline(spark, x):
    assert value(spark, t.bad_pipeline(d, "x"), x=x)


def test_good_answers(spark):
    for x in ("Dwight Schultz", "Sapsali", "British"):
        assert not value(spark, t.bad_pipeline(d, "x"), x=x)


@pytest.mark.parametrize(("q", "want"), [("Are both of them actors?", "yesno"), ("Who was born first, A or B?", "comparison"), ("What award did she win?", "award"), ("Where is it?", "location"), ("Who directed it?", "person"), ("Is it red or blue?", "choice"), ("How many are there?", "number")])
def test_answer_type(spark, q, want):
    assert value(spark, c.answer_type(d, "q"), q=q) == want


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    from veritrail.sources import files

    (tmp_path / "a.jsonl").write_text('{"_id": "1", "question": "q"}\n\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('{"data": [{"_id": "3"}]}')
    (tmp_path / "c.json").write_text('{"k1": {"question": "x"}, "k2": {"question": "y"}}')
    (tmp_path / "d.json").write_text('[{"_id": "5"}, {"_id": "6"}]')
    assert files.read_records(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert [r["_id"] for r in files.read_records(spark, f"{tmp_path}/b.json").collect()] == ["3"]
    assert sorted(r["_id"] for r in files.read_records(spark, f"{tmp_path}/c.json").collect()) == ["k1", "k2"]
    assert sorted(r["_id"] for r in files.read_records(spark, f"{tmp_path}/d.json").collect()) == ["5", "6"]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert files.read_optional(spark, f"{tmp_path}/none", schema).count() == 0
    for n, part in enumerate(([(1, "a"), (2, "b")], [(2, "c")])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/p{n}")
    got = files.read_sources(spark, [f"{tmp_path}/p0", f"{tmp_path}/p1", f"{tmp_path}/p9"], schema, "k")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, [f"{tmp_path}/p9"], schema, "k")
    files.append_missing(spark.createDataFrame([(1, "z"), (7, "n")], schema), f"{tmp_path}/p0", "k")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/p0").collect())) == [(1, "a"), (2, "b"), (7, "n")]
    assert files.forbidden_fields(T.StructType([T.StructField("x", T.ArrayType(schema))]), {"v"}) == ["x[].v"]


def test_reader(spark):
    from veritrail.operators.reader import iterative, read

    df = spark.createDataFrame([(1, "Who wrote the book?", "It rained. Ann wrote the book. Fine."), (2, None, None)], "qid long, question string, evidence string")
    got = {r["qid"]: r["answer"] for r in read(df).collect()}
    assert got == {1: "Ann wrote the book.", 2: "unknown"}
    sentences = spark.createDataFrame([(1, 0, "It rained."), (1, 1, "Ann wrote the book.")], "qid long, pos int, sentence string")
    assert iterative(df.select("qid", "question"), sentences).where("qid = 1").first()["answer"] == "Ann wrote the book."


def test_streaming(spark, sf, tmp_path):
    from veritrail.streaming import usage

    folder = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(folder))
    query = usage.usage_by_case(usage.event_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    query.processAllAvailable()
    query.stop()
    got = {r["qid"]: (r["calls"], round(r["tokens"], 4)) for r in spark.sql("SELECT * FROM usage").collect()}
    want = {r["qid"]: (r["calls"], round(r["tokens"], 4)) for r in usage.usage_by_case(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got == want
    usage.append_log(usage.event_stream(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize(("question", "kind"), [("Are both of them", "yesno"), ("Which is older, X or Y?", "comparison"), ("What year was it?", "number_date"), ("Where is it?", "location"), ("The man who made it", "person"), ("What have they in common", "common"), ("Name it", "other")])
def test_selector_question_kinds(spark, question, kind):
    from veritrail.plans import selectors as s

    assert value(spark, s.question_kind(d, "q"), q=question) == kind


def test_selector_weighs_fields_and_sources(spark):
    from veritrail.plans import selectors as s

    weight = lambda source, field: value(spark, s.field_weight(d, "s", "f"), s=source, f=field)
    assert weight("x_candidate_choice", "candidate_choice_answer") == 6.0
    assert weight("x_contextual_prior_v2", "contextual_prior_v2") == 7.5
    assert weight("x_evidence_reader", "candidate_reader_v1") == 3.5
    assert weight("other", "answer") == 1.0


def selected(spark, groups, current, **limits):
    """n6_selector over given occurrences: the rows of one question in place of the turns' own."""
    from veritrail.plans import selectors as s

    rows = [("1", i, *g) for i, g in enumerate(groups)]
    spark.createDataFrame(rows, "qid string, pos int, source string, field string, value string").createOrReplaceTempView("given_occurrences")
    spark.createDataFrame([("1", "Name it", current)], "qid string, question string, first string").createOrReplaceTempView("given_turns")
    text = s.n6_selector(d, **limits)
    a, b = text.index("asked AS ("), text.index("kept AS (")
    text = text[:a] + "turns AS (SELECT * FROM given_turns), occurrences AS (SELECT * FROM given_occurrences), " + text[b:]
    return spark.sql(text).first()


def test_selector_compares_with_the_current_answer_and_ten(spark):
    rivals = [("a_candidate_choice", "candidate_choice_answer", "Paris"), ("b_contextual_prior_v2", "contextual_prior_v2", "paris."), ("c_evidence_reader", "candidate_context", "Paris")]
    # Weights 6 + 7.5 + 6, three occurrences 2.4, three kinds 4.5, prior field 3, context field 2, choice 2, prior 1.
    got = selected(spark, rivals, "London", min_score=12.0, min_margin=24.4, min_occurrences=3)
    assert (got["candidate_score"], got["current_score"], got["answer"], got["rule"], got["occurrences"]) == (34.4, 10.0, "Paris", "conflict_other", 3)
    # The margin is over the current score and ten: a tenth more is too much, as are four occurrences.
    assert selected(spark, rivals, "London", min_score=12.0, min_margin=24.5, min_occurrences=3)["answer"] == "London"
    assert selected(spark, rivals, "London", min_score=12.0, min_margin=1.0, min_occurrences=4)["rule"] == "current"
    # The current answer's own occurrences count for it.
    own = [("d_evidence_reader", "candidate_context", "London")]
    assert selected(spark, rivals + own, "London", min_score=12.0, min_margin=1.0, min_occurrences=3)["current_score"] == 10 + 6 + 0.8 + 1.5 + 2
    # A mere alias of the current answer doesn't replace it, nor does one without a field of the prior or context.
    assert selected(spark, rivals, "Paris, France", min_score=0.0, min_margin=-99.0, min_occurrences=1)["rule"] == "current"
    assert selected(spark, rivals[:1], "London", min_score=0.0, min_margin=-99.0, min_occurrences=1)["rule"] == "current"


@pytest.mark.parametrize(("current", "candidate", "question", "want"), [
    ("John Smith", "John Paul Smith", "Who made it?", True), ("John Smith", "John Paul Smith", "What is it?", False), ("Smith", "John Smith", "Who made it?", False), ("John Smith", "Friends of John Smith", "Who made it?", False),
    ("J Smith", "Smith J Jones", "Who made it?", False), ("John Smith", "The John B Smith", "Who made it?", False),
])
def test_person_expansion(spark, current, candidate, question, want):
    from veritrail.plans import selectors as s

    assert value(spark, s.person_expansion(d, "c", "x", "q"), c=current, x=candidate, q=question) is want


@pytest.mark.parametrize(("current", "candidate", "question", "want"), [("Baroque composers", "Baroque", "What genre is it?", True), ("steel industry", "steel", "What industry is it?", True), ("steel industry", "iron", "What industry is it?", False), ("Lost with Ann", "Lost", "Which television series is it?", True), ("a, b industry", "b", "What industry is it?", False)])
def test_concise_forms(spark, current, candidate, question, want):
    from veritrail.plans import selectors as s

    assert value(spark, s.concise(d, "c", "x", "q"), c=current, x=candidate, q=question) is want


def test_distances_in_rounds(spark):
    from veritrail.operators.components import distances

    edges = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (8, 9)]
    sides = spark.createDataFrame(edges + [(b, a) for a, b in edges], "x long, y long")
    got = {(r["origin"], r["node"]): r["hops"] for r in distances(sides, spark.createDataFrame([(0,), (9,)], "origin long"), 2).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 4): 1, (0, 2): 2, (0, 3): 2, (9, 9): 0, (9, 8): 1}


GATE = {
    "question": "Who made it?", "kind": "person", "current": "Ann Lee", "proposed": "Bob Ray", "should_switch": True, "action": "switch", "conf": "high", "sufficient": True, "why": "it says so", "source": "reader_v1 support",
    "quote_1": "It was made by Bob Ray in 1999.", "quote_2": "Bob Ray was then thirty years old.", "passage": "It was made by Bob Ray in 1999. Bob Ray was then thirty years old.", "known": True, "before": "accepted",
}


@pytest.mark.parametrize(("gate", "change", "want"), [
    *((g, {}, "accepted") for g in ("type_aware", "two_stage", "strict_quote", "kg_challenger", "focused_passage", "conservative", "conservative_v2", "strict_quote_v2")),
    ("type_aware", {"proposed": "the Ann Lee."}, "same_as_current"), ("type_aware", {"proposed": "unknown", "should_switch": False}, "bad_surface"), ("type_aware", {"should_switch": False, "conf": "low"}, "should_switch_false"), ("type_aware", {"conf": "low"}, "low_confidence"),
    ("type_aware", {"kind": "yesno"}, "yesno_not_binary"), ("type_aware", {"kind": "number_date"}, "number_date_without_number"), ("type_aware", {"kind": "number_date", "proposed": "in May", "passage": "it was in May"}, "accepted"), ("type_aware", {"proposed": "Tim Orr"}, "not_grounded"),
    ("two_stage", {"sufficient": False, "proposed": "Ann Lee"}, "locator_insufficient"), ("two_stage", {"question": 'Who made "The Sea"?'}, "missing_quoted_constraint"), ("strict_quote", {"conf": "medium"}, "not_high_confidence"), ("strict_quote", {"quote_2": "Nobody has said these words."}, "quote_not_verbatim"),
    ("strict_quote", {"proposed": "Tim Orr"}, "answer_not_quote_grounded"), ("kg_challenger", {"action": "keep"}, "action_not_switch"), ("kg_challenger", {"why": "Keep current."}, "reason_keeps_current"), ("kg_challenger", {"known": False}, "not_kg_candidate"),
    ("focused_passage", {"kind": "location", "proposed": "Ray University", "passage": "at Ray University"}, "location_org_like"), ("conservative", {"known": False}, "not_candidate"), ("conservative_v2", {"source": "reader_v1"}, "reader_only_source"),
    ("conservative_v2", {"question": "Where is it?", "current": "York, a city"}, "location_type_mismatch"), ("strict_quote_v2", {"before": "bad_surface"}, "bad_surface"), ("strict_quote_v2", {"question": "Which film is it?"}, "film_type_mismatch"),
])
def test_acceptance_gates(spark, gate, change, want):
    from veritrail.plans import selectors as s

    assert value(spark, s.gate_reason(s.gates(d)[gate]), **(GATE | change)) == want
