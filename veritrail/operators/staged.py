"""The staged question-answering program: decompose, retrieve, check, repair, read, refine.

Every stage is a step over all questions at once. Modes leave stages out (no_decomp asks
the question as it stands, no_verif checks and repairs nothing); ablations switch off
verification, repair, passages for the reader, or refinement of answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import text as t
from veritrail.functions.dialect import SPARK
from veritrail.operators.reader import Reader, extractive, read

MODES = ("full", "no_verif", "no_decomp")
ABLATIONS = ("none", "without_verification", "without_repair", "without_reader_context", "without_answer_refinement")
#: Triples that one question retrieves, and capitalized words that a question may begin with and that name nothing.
MOST_TRIPLES = 50
OPENERS = ("What", "Who", "Which", "Where", "When", "How", "Why", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "The", "In")


def names(question: Column) -> Column:
    """Capitalized words, in lower case, without those that only open a question."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"(\p{Lu}[\p{L}\p{N}_-]*)"))
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~x.isin(*OPENERS)), F.lower))


def decomposed(questions: DataFrame, mode: str = "full") -> DataFrame:
    """qid, place and subquery: the parts between 'and' and marks, or the whole question."""
    parts = F.array(F.col("question")) if mode == "no_decomp" else F.filter(F.split(F.coalesce("question", F.lit("")), r"(?i)\s+and\s+|[?;]\s*"), lambda x: F.trim(x) != "")
    return questions.select("qid", F.posexplode_outer(parts).alias("place", "subquery"))


def retrieved(subqueries: DataFrame, triples: DataFrame) -> DataFrame:
    """qid, h, r, t of triples (h, r, t) one end of which a subquery names: MOST_TRIPLES of each question, by subquery and text."""
    asked = subqueries.select("qid", "place", F.explode(names(F.col("subquery"))).alias("name"))
    ends = triples.select("h", "r", "t", F.explode(F.array_distinct(F.array(F.lower("h"), F.lower("t")))).alias("name"))
    met = asked.join(ends, "name").groupBy("qid", "h", "r", "t").agg(F.min("place").alias("place"))
    return met.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("place", "h", "r", "t"))).where(F.col("n") <= MOST_TRIPLES).select("qid", "h", "r", "t")


def checked(questions: DataFrame, found: DataFrame) -> DataFrame:
    """qid, gap (missing_entities, short_chain or complete) and missing: names of the question that no triple holds."""
    ends = found.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.lower("h"), F.lower("t"))))).alias("ends"), F.count("*").alias("n"))
    rows = questions.join(ends, "qid", "left").select("qid", names(F.col("question")).alias("names"), F.coalesce("ends", F.array().cast("array<string>")).alias("ends"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = rows.select("qid", F.array_except("names", "ends").alias("missing"), F.size("names").alias("asked"), "n")
    return rows.select("qid", "missing", F.when(F.size("missing") > 0, "missing_entities").when((F.col("asked") >= 2) & (F.col("n") < F.col("asked") - 1), "short_chain").otherwise("complete").alias("gap"))


def repairs(gaps: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, h, r, t read from a question's own passages (qid, passage) about the names that its gap lacks."""
    pattern = r"(\p{Lu}[\p{L}\p{N}_-]*) (\p{Ll}+(?: \p{Ll}+)?) (\p{Lu}[\p{L}\p{N}_-]*)"
    parts = [F.regexp_extract_all("passage", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = passages.join(gaps.where(F.size("missing") > 0), "qid").select("qid", "missing", F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "hrt", strict=True)])).alias("x"))
    rows = rows.select("qid", "missing", F.col("x.h").alias("h"), F.lower("x.r").alias("r"), F.col("x.t").alias("t"))
    return rows.where((F.col("h") != F.col("t")) & (F.array_contains("missing", F.lower("h")) | F.array_contains("missing", F.lower("t")))).select("qid", "h", "r", "t").distinct()


def run(questions: DataFrame, triples: DataFrame, passages: DataFrame, mode: str = "full", ablation: str = "none", reader: Reader = extractive) -> DataFrame:
    """One row for each question (qid, question): answer, gap, missing, and what was done or switched off.

    A question without triples is read from its passages at once (no_triples_fallback). A null question has no
    subqueries and is answered 'unknown'; passages without a question are not read.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if ablation not in ABLATIONS:
        raise ValueError(f"ablation must be one of {', '.join(ABLATIONS)}")
    verify = mode != "no_verif" and ablation != "without_verification"
    repair = verify and ablation != "without_repair"
    with_passages = ablation != "without_reader_context"
    refine = ablation not in ("without_reader_context", "without_answer_refinement")

    found = retrieved(decomposed(questions, mode), triples)
    any_found = found.select("qid").distinct().withColumn("has_triples", F.lit(True))
    gaps = checked(questions, found) if verify else questions.select("qid", F.array().cast("array<string>").alias("missing"), F.lit("unchecked").alias("gap"))
    added = repairs(gaps.join(any_found, "qid", "left_semi"), passages) if repair else found.where("false")
    repaired = added.select("qid").distinct().withColumn("repaired", F.lit(True))
    whole = found.unionByName(added).distinct()
    facts = whole.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "h", "r", F.concat("t", F.lit("."))))), " ").alias("facts"))
    texts = passages.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("passage")), " ").alias("passages"))
    after = (checked(questions, whole) if repair else gaps).select("qid", F.col("gap").alias("gap"), "missing")

    rows = questions.join(facts, "qid", "left").join(texts, "qid", "left").join(any_found, "qid", "left").join(repaired, "qid", "left").join(after, "qid", "left")
    fallback = F.col("has_triples").isNull()
    evidence = F.when(fallback, F.col("passages")).otherwise(F.concat_ws(" ", "facts", F.col("passages") if with_passages else F.lit("")))
    rows = read(rows.withColumn("evidence", evidence), reader)
    if refine:
        # An answer that is none gives way to what the passages alone say.
        again = read(rows.withColumnRenamed("answer", "first_answer").drop("confidence"), reader, evidence="passages")
        bad = F.expr(t.bad_pipeline(SPARK, "first_answer"))
        rows = again.withColumn("used", bad & ~F.expr(t.bad_pipeline(SPARK, "answer"))).withColumn("answer", F.when(F.col("used"), F.col("answer")).otherwise(F.col("first_answer")))
    else:
        rows = rows.withColumn("used", F.lit(False))
    steps = lambda test, name: F.when(test, F.lit(name)).otherwise(F.lit(""))
    return rows.select(
        "qid", "answer", "gap", F.array_join(F.array_sort("missing"), "|").alias("missing"), steps(F.col("repaired").isNotNull(), "passage_repair").alias("repair_steps"), steps(fallback, "no_triples_fallback").alias("fallback_steps"),
        F.lit(ablation).alias("ablation"), F.lit(not verify).alias("verification_disabled"), F.lit(not repair).alias("repair_disabled"), F.lit(not with_passages).alias("reader_context_disabled"), F.col("used").alias("refinement_used"),
    )
