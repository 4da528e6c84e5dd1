"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Four counts of a text are held against cutoffs (in thousandths). For each stratum, rule
and cutoff, the labelled documents of quality 1 say how often the rule would reject a
good one; the chance of seeing no more rejections if the true rate were RISK / rules is
an exact binomial tail. A cutoff may be used if that chance is at most DELTA divided by
the number of tests (Bonferroni over strata, rules and cutoffs), and each rule takes the
lowest cutoff that may be used. With confidence 1 - DELTA, then, no stratum loses more
than RISK of its good documents to the rules.

Defined results: a null or empty text has no words and fails the base; a stratum without
enough labels gets no cutoffs and loses nothing to the rules; a null stratum is one of
its own; of several labels of one doc_id the greatest counts; repeated rows are judged
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import written

RISK = 0.02
DELTA = 0.05
#: Cutoffs in thousandths.
CUTOFFS = (20, 50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
#: What is held against the cutoffs: counts and what they are counted in.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "one_line": ("n_word_lines_short", "n_lines")}
MIN_WORDS, MOST_REPEATED = 50, 50

_SPACE = r"[\\x20\\x09-\\x0D]"


def measured(docs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each text. Arrays stay in their row; nothing is exploded or shuffled."""
    kept = F.col(f"`{stratum}`").cast("string") if stratum else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kept.alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # inline() holds the split text: an expression on words isn't folded into the split and so run again for each word.
    rows = base.selectExpr(
        "doc_id", "stratum",
        f"inline(array(struct(array_remove(split(text, '{_SPACE}+'), '') AS words, filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines, "
        f"length(text) - regexp_count(text, '{_SPACE}') AS word_chars, regexp_count(text, '[#*$%&|<>]') AS n_symbols)))",
    )
    # A three-word window is a hash whose low bits are its place; sorted, equal windows are neighbours.
    rows = rows.selectExpr("*", "size(words) AS n", "cast(ceil(log2(size(words) + 2)) AS int) AS bits")
    rows = rows.selectExpr(
        "*",
        "inline(array(struct(CASE WHEN n < 4 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, n - 3), "
        "i -> shiftleft(shiftright(xxhash64(words[i], words[i + 1], words[i + 2]), bits), bits) | i)) END AS sorted)))",
    )
    place = lambda x: f"cast({x} & (shiftleft(1L, bits) - 1) AS int)"
    same = lambda x, y: f"(shiftright({x}, bits) = shiftright({y}, bits) AND " + " AND ".join(f"words[{place(x)} + {j}] = words[{place(y)} + {j}]" for j in range(3)) + ")"
    rows = rows.selectExpr(
        "doc_id", "stratum", "cast(n AS bigint) AS n_words", "cast(word_chars AS bigint) AS word_chars", "cast(n_symbols AS bigint) AS n_symbols",
        "cast(size(lines) AS bigint) AS n_lines", "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines",
        "cast(size(filter(lines, x -> length(x) < 10)) AS bigint) AS n_word_lines_short",
        f"sort_array(transform(filter(sorted, (x, i) -> (i > 0 AND {same('x', 'sorted[i - 1]')}) OR (i < size(sorted) - 1 AND {same('x', 'sorted[i + 1]')})), x -> {place('x')})) AS twice",
    )
    covered = "cast(aggregate(twice, struct(-3 AS last, 0 AS total), (s, x) -> struct(x AS last, s.total + least(3, x - s.last) AS total), s -> s.total) AS bigint)"
    return rows.withColumn("n_repeat_words", F.expr(covered)).drop("twice")


def thresholds(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule and cutoff (thousandths) of each rule that a stratum may use."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = counts.join(good.where("quality = 1").drop("quality"), "doc_id")
    grid = ", ".join(map(str, CUTOFFS))
    levels = ", ".join(f"struct('{r}' AS rule, size(filter(array({grid}), c -> 1000 * {a} > c * {b})) AS level)" for r, (a, b) in RULES.items())
    counted = rows.selectExpr("stratum", f"inline(array({levels}))").groupBy("stratum", "rule", "level").agg(F.count("*").alias("m"))
    # At most strata x rules x cutoffs rows from here on.
    each = counted.selectExpr("stratum", "rule", "m", "level", f"posexplode(array({grid})) AS (at, cutoff)")
    seen = each.groupBy("stratum", "rule", "cutoff").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("level") > F.col("at"), F.col("m")).otherwise(0)).alias("k"))
    seen = written(seen, "tests")
    tests = max(1, seen.count())
    p = risk / len(RULES)
    # The tail: terms of the binomial by their ratio, in logarithms; above the mean it can't be small.
    tail = (
        f"CASE WHEN k >= n * {p}D THEN 1D ELSE aggregate(sequence(0, cast(k AS int)), struct(0D AS term, 0D AS total), (s, i) -> "
        f"named_struct('term', CASE WHEN i = 0 THEN n * ln(1 - {p}D) ELSE s.term + ln((n - i + 1) / i) + ln({p}D / (1 - {p}D)) END, "
        f"'total', s.total + exp(CASE WHEN i = 0 THEN n * ln(1 - {p}D) ELSE s.term + ln((n - i + 1) / i) + ln({p}D / (1 - {p}D)) END)), s -> s.total) END"
    )
    safe = seen.where(f"{tail} <= {delta}D / {tests}")
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    counts = written(measured(docs, stratum), "counts")
    chosen = thresholds(counts, labels).groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    chosen = chosen.withColumnRenamed("stratum", "of")
    rows = counts.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    rejected = " OR ".join(f"coalesce(1000 * {a} > cut_{r} * {b}, false)" for r, (a, b) in RULES.items())
    return rows.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"({failed}) AS base_failed", f"NOT ({failed}) AND NOT ({rejected}) AS kept")


def _sql() -> str:
    """The same for DuckDB, over documents and labels."""
    p, grid = RISK / len(RULES), ", ".join(f"({c})" for c in CUTOFFS)
    rules = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {a} AS a, {b} AS b FROM good" for r, (a, b) in RULES.items())
    cuts = ", ".join(f"min(CASE WHEN rule = '{r}' THEN cutoff END) AS cut_{r}" for r in RULES)
    rejected = " OR ".join(f"coalesce(1000 * {a} > cut_{r} * {b}, false)" for r, (a, b) in RULES.items())
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
parted AS (SELECT r, doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
placed AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM parted WHERE len(words) > 2),
windows AS (SELECT r, i, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3 FROM placed),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY r),
counts AS (SELECT p.r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(lines, lambda x: length(x) < 10)) AS BIGINT) AS n_word_lines_short,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM parted p LEFT JOIN covered c ON p.r = c.r),
good AS (SELECT c.* FROM counts c JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) l USING (doc_id)),
measured AS ({rules}),
seen AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE 1000 * a > cutoff * b) AS k FROM measured, (VALUES {grid}) g(cutoff) GROUP BY ALL),
tests AS (SELECT count(*) AS tests FROM seen),
safe AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM seen, tests WHERE k < n * {p} AND
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) <= {DELTA} / tests GROUP BY stratum, rule),
chosen AS (SELECT stratum AS of, {cuts} FROM safe GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT ({rejected}) AS kept
FROM counts LEFT JOIN chosen ON stratum IS NOT DISTINCT FROM of"""


SQL = _sql()
