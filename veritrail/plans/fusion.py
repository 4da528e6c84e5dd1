"""Candidate fusion, selection, joins, set operations and bookkeeping plans."""

from __future__ import annotations

from veritrail.functions import classify as c
from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import views as v


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


def _normed(d: Spark) -> str:
    return f"normed AS (SELECT qid, src, field, value, pos, {t.normalized(d, 'value')} AS norm FROM candidates)"


def g21_consensus(d: Spark) -> str:
    """The most common normalized answer if at least two sources give it; the first seen breaks ties."""
    first = "min_by(value, pos)" if d.name == "spark" else "arg_min(value, pos)"
    return f"""{_with(d, v.candidates(d), _normed(d))}, g AS (SELECT qid, norm, count(*) AS n, min(pos) AS pos, {first} AS value FROM normed WHERE norm <> '' GROUP BY qid, norm),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, pos) AS r FROM g) SELECT qid, value AS answer, cast(n AS bigint) AS votes FROM r WHERE r = 1 AND n >= 2"""


_WEIGHTS = "CASE src WHEN 'context' THEN 4 WHEN 'graph' THEN 3 WHEN 'reader' THEN 2 ELSE 1 END"


def g22_groups(d: Spark) -> str:
    """Candidates by normalized form: the shortest surface, sources, and summed weights; ranked."""
    sources = "collect_set(src)" if d.name == "spark" else "list(DISTINCT src)"
    return f"""{_with(d, v.candidates(d), _normed(d))}, g AS (SELECT qid, norm, min(concat(lpad(cast(length(value) AS string), 6, '0'), value)) AS short, {d.joined(d.sorted(sources), '|')} AS sources, count(DISTINCT src) AS n_sources,
  sum({_WEIGHTS}) AS score, max(CASE WHEN src = 'reader' THEN 1 ELSE 0 END) AS is_current FROM normed WHERE norm <> '' GROUP BY qid, norm)
  SELECT qid, norm, substring(short, 7) AS surface, sources, cast(score AS bigint) AS score, cast(row_number() OVER (PARTITION BY qid ORDER BY is_current DESC, score DESC, n_sources DESC, norm) AS bigint) AS r FROM g"""


def g23_ceiling(d: Spark) -> str:
    """The best candidate of each question and how the current answer stands to it; the gold is the last word."""
    return f"""{_with(d, v.candidates(d), _normed(d))}, gold AS (SELECT qid, {t.normalized(d, "last_word")} AS g FROM wide), scored AS (SELECT n.qid, src, pos, CASE WHEN norm = g THEN 1 ELSE 0 END AS em, CASE WHEN norm <> '' AND g <> '' AND contains(norm, g) THEN 1 ELSE 0 END AS part FROM normed n JOIN gold ON n.qid = gold.qid WHERE src <> 'tail'),
  best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY em DESC, part DESC, pos) AS r FROM scored), cur AS (SELECT qid, em FROM scored WHERE src = 'reader'),
  joined AS (SELECT b.qid, b.em AS best_em, b.part, c.em AS cur_em FROM best b JOIN cur c ON b.qid = c.qid WHERE b.r = 1)
  SELECT CASE WHEN cur_em = 1 THEN 'current_right' WHEN best_em = 1 THEN 'selectable' WHEN part = 1 THEN 'partial' ELSE 'absent' END AS class, cast(count(*) AS bigint) AS n, round(avg(cast(cur_em AS double)), 4) AS current_em, round(avg(cast(best_em AS double)), 4) AS oracle_em FROM joined GROUP BY 1"""


def n8_agreement(d: Spark) -> str:
    """The first ordered pair of sources that agree on a normalized answer, else the reader's."""
    pairs = (("reader", "prior"), ("graph", "context"), ("reader", "graph"), ("context", "prior"), ("baseline", "prior"))
    value = lambda s, x: f"max(CASE WHEN src = '{s}' THEN {x} END) AS {s}_{x}"
    cols = ", ".join(value(s, x) for s in ("reader", "graph", "context", "baseline", "prior") for x in ("norm", "value"))
    cases = " ".join(f"WHEN {a}_norm <> '' AND {a}_norm = {b}_norm THEN '{a}+{b}'" for a, b in pairs)
    return f"{_with(d, v.candidates(d), _normed(d))}, w AS (SELECT qid, {cols} FROM normed GROUP BY qid), k AS (SELECT *, CASE {cases} ELSE 'none' END AS rule FROM w) SELECT qid, rule, CASE WHEN rule = 'graph+context' OR rule = 'context+prior' THEN context_value WHEN rule = 'baseline+prior' THEN baseline_value ELSE reader_value END AS answer FROM k"


def n2_context(d: Spark) -> str:
    """Prefer a context answer to a bad current one, else only as its expansion."""
    cur, ctx = t.tokens(d, "pred"), t.tokens(d, "gold")
    expansion = f"{d.size('c')} >= 2 AND {t.subset(d, 'c', 'x')} AND NOT {t.subset(d, 'x', 'c')} AND contains(lower(gold), lower(pred)) AND NOT contains(gold, ',') AND NOT contains(lower(gold), ' and ') AND NOT {t.starts_any(d, 'lower(gold)', ('a ', 'an ', 'the ', "people's republic"))} AND {d.ends('lower(gold)', 'lower(pred)')}"
    return f"{_with(d, v.pairs(d))}, k AS (SELECT qid, pred, gold, {cur} AS c, {ctx} AS x FROM pairs) SELECT qid, gold <> '' AND NOT {t.bad_pipeline(d, 'gold')} AND ({t.bad_pipeline(d, 'pred')} OR ({t.sorted_key(d, 'pred')} <> {t.sorted_key(d, 'gold')} AND {expansion})) AS prefer_context FROM k"


def n3_challenger(d: Spark) -> str:
    """Acceptance of a challenger with its reason."""
    c_, x = t.tokens(d, "pred"), t.tokens(d, "gold")
    return f"""{_with(d, v.pairs(d))}, k AS (SELECT qid, pred, gold, {c_} AS c, {x} AS x, CASE qid % 7 WHEN 0 THEN 'KEEP_CURRENT' ELSE 'C1' END AS label, cast((qid * 13) % 20 AS double) / 20 AS conf, CASE qid % 4 WHEN 0 THEN 'award' WHEN 1 THEN 'person' WHEN 2 THEN 'common' ELSE 'other' END AS kind FROM pairs),
  e AS (SELECT *, {d.size("c")} > 0 AND {t.subset(d, "c", "x")} AND NOT {t.subset(d, "x", "c")} AS expansion FROM k)
  SELECT qid, CASE WHEN label IN ('', 'KEEP_CURRENT') THEN 'choice_keep_current' WHEN conf < 0.55 THEN 'low_choice_confidence' WHEN gold = '' OR {t.bad_pipeline(d, "gold")} THEN 'bad_challenger' WHEN {t.sorted_key(d, "pred")} = {t.sorted_key(d, "gold")} THEN 'same_as_current'
  WHEN {t.bad_pipeline(d, "pred")} THEN 'current_bad' WHEN kind = 'award' AND expansion AND {d.size("x")} <= 12 THEN 'award_expansion' WHEN kind IN ('award', 'common') THEN concat(kind, '_candidate_choice') WHEN conf >= 0.85 THEN concat(kind, '_high_confidence_choice') ELSE 'keep_current' END AS reason FROM e"""


def n5_best_iteration(d: Spark) -> str:
    """The step of the highest value of each user; an earlier one wins ties."""
    pick = "max_by(event_id, struct(value, -event_id))" if d.name == "spark" else "arg_max(event_id, (value, -event_id))"
    return f"SELECT user_id, {pick} AS best_event, max(value) AS best FROM events GROUP BY user_id"


def n12_overlay(d: Spark) -> str:
    """Targeted replacements over a base table; only rows that differ change."""
    return f"{_with(d, v.candidates(d))}, fix AS (SELECT qid, opening AS answer FROM wide WHERE qid % 7 = 0) SELECT w.qid, coalesce(f.answer, w.first_word) AS answer, f.answer IS NOT NULL AND f.answer <> w.first_word AS replaced FROM wide w LEFT JOIN fix f ON w.qid = f.qid"


def n16_alternatives(d: Spark) -> str:
    """Distinct alternatives to the current answer in fixed order."""
    if d.name == "spark":
        # Each answer is normalized once, and rows of a document meet by one shuffle of these forms.
        forms = ", ".join(f"struct({i} AS pos, {t.normalized(d, x)} AS norm)" for i, x in ((1, "first_word"), (2, "second_word"), (3, "opening"), (4, "lang"), (5, "first_word"), (6, "last_word")))
        return f"""{_with(d, v.candidates(d))}, n AS (SELECT qid, a.pos, a.norm FROM (SELECT qid, explode(array({forms})) AS a FROM wide WHERE qid IS NOT NULL) x), w AS (SELECT *, collect_set(CASE WHEN pos = 1 THEN norm END) OVER (PARTITION BY qid) AS currents FROM n),
  f AS (SELECT qid, norm, min(pos) AS pos FROM w WHERE norm <> '' AND exists(currents, c -> c <> norm) GROUP BY qid, norm) SELECT qid, norm, cast(row_number() OVER (PARTITION BY qid ORDER BY pos) AS bigint) AS place FROM f"""
    return f"""{_with(d, v.candidates(d), _normed(d))}, cur AS (SELECT qid, norm AS current FROM normed WHERE src = 'reader'), f AS (SELECT n.qid, n.norm, min(n.pos) AS pos FROM normed n JOIN cur c ON n.qid = c.qid WHERE n.norm <> '' AND n.norm <> c.current GROUP BY n.qid, n.norm)
  SELECT qid, norm, cast(row_number() OVER (PARTITION BY qid ORDER BY pos) AS bigint) AS place FROM f"""


def t34_rules(d: Spark) -> str:
    """One wide row of counts by rule."""
    inner = n8_agreement(d).replace("SELECT qid, rule, CASE WHEN rule = 'graph+context'", "SELECT qid, rule, CASE WHEN rule = 'graph+context'")
    rules = ("reader+prior", "graph+context", "reader+graph", "context+prior", "baseline+prior", "none")
    return f"SELECT cast(count(*) AS bigint) AS n, {', '.join(f'''cast(sum(CASE WHEN rule = '{r}' THEN 1 ELSE 0 END) AS bigint) AS n_{r.replace('+', '_')}''' for r in rules)} FROM ({inner}) ruled"


def f1_gold_join(d: Spark) -> str:
    """Every gold row once; a missing prediction scores as empty; of several predictions the last counts."""
    return f"""WITH preds AS (SELECT user_id AS qid, event_type AS pred, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), gold AS (SELECT c_custkey AS qid, c_mktsegment AS gold FROM customer)
  SELECT gold.qid, gold, coalesce(pred, '') AS pred, CASE WHEN coalesce(pred, '') = '' THEN 0 ELSE {t.exact(d, "pred", "gold")} END AS em FROM gold LEFT JOIN preds ON gold.qid = preds.qid AND r = 1"""


def f5_overlap(d: Spark) -> str:
    """Members of one set in another, and those that aren't."""
    return "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'anti' ELSE 'semi' END AS side FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"


def f6_resume(d: Spark) -> str:
    """Rows still to do: those whose key isn't among the finished."""
    return "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')"


def i1_union(d: Spark) -> str:
    """Local rows, then global ones; the first occurrence of each text stays."""
    return f"""WITH u AS (SELECT 0 AS part, item_id AS pos, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents), k AS (SELECT part, pos, {d.sha("text")} AS k, row_number() OVER (PARTITION BY text ORDER BY part, pos) AS r FROM u) SELECT part, pos, k FROM k WHERE r = 1"""


def i2_sets(d: Spark) -> str:
    return f"""{_with(d, v.pairs(d))}, k AS (SELECT qid, {d.distinct(t.tokens(d, "pred"))} AS a, {d.distinct(t.tokens(d, "gold"))} AS b FROM pairs)
  SELECT qid, {d.joined(d.sorted(d.common("a", "b")), " ")} AS both_, {d.joined(d.sorted(d.filter("a", "x", f"NOT {d.holds('b', 'x')}")), " ")} AS only_a, {t.subset(d, "a", "b")} AND {d.size("a")} < {d.size("b")} AS strict_subset FROM k"""


def i3_multiset(d: Spark) -> str:
    return f"{_with(d, v.pairs(d))}, k AS (SELECT qid, {t.tokens(d, 'pred')} AS a, {t.tokens(d, 'gold')} AS b FROM pairs) SELECT qid, {t.overlap(d, 'a', 'b')} AS shared FROM k"


def i4_pool(d: Spark) -> str:
    """A pool without the union of two sets."""
    return "WITH used AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = d.doc_id)"


def h4_dedup(d: Spark) -> str:
    """First-seen and last-wins rows of each key."""
    return "WITH k AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS l FROM events) SELECT user_id, event_type, max(CASE WHEN f = 1 THEN event_id END) AS first_id, max(CASE WHEN l = 1 THEN event_id END) AS last_id FROM k GROUP BY user_id, event_type"


def t1_shards(d: Spark) -> str:
    """Round-robin and contiguous shards of rows in order."""
    k = v.placed("k", "conversations", "k.conv_id, k.turn", "floor(conv_id / 256)")
    return f"WITH {k} SELECT conv_id, turn, cast((pos - 1) % 4 AS bigint) AS round_robin, cast(floor(cast((pos - 1) * 4 AS double) / total) AS bigint) AS range_shard FROM k"


def t4_ordered_merge(d: Spark) -> str:
    ordered = v.placed("ordered", "questions", "k.conv_id, k.turn", "floor(conv_id / 256)")
    return f"{_with(d, v.questions(d), ordered)} SELECT q.qid, pos, coalesce(a.text, '') AS answer FROM ordered q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'"


def t6_bodies(d: Spark) -> str:
    """One row for each distinct body; the first title wins."""
    first = "min_by(source, doc_id)" if d.name == "spark" else "arg_min(source, doc_id)"
    return f"SELECT {d.sha('text')} AS body, min(doc_id) AS doc_id, {first} AS title, cast(count(*) AS bigint) AS n FROM documents GROUP BY text"


def b3_export(d: Spark) -> str:
    """A bad prediction gives way to a non-empty fallback."""
    return f"{_with(d, v.candidates(d))} SELECT qid, CASE WHEN {t.bad_evaluation(d, 'second_word')} AND first_word <> '' THEN first_word ELSE second_word END AS prediction FROM wide"


def b6_cache_keys(d: Spark) -> str:
    """Keys of mode, variant, ablation and iteration; the default variant has a short one."""
    return "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat_ws('_', 'cache', event_type) ELSE concat_ws('_', 'cache', event_type, concat('v', cast(user_id % 3 AS string)), CASE WHEN user_id % 2 = 0 THEN 'without_repair' END, concat('it', cast(event_id % 4 AS string))) END AS key FROM events"


def b7_reuse(d: Spark) -> str:
    """Whether a cached row may be used again."""
    return f"{_with(d, v.candidates(d))} SELECT qid, CASE WHEN first_word = '' THEN false WHEN qid % 2 = 0 AND {t.bad_evaluation(d, 'first_word')} THEN false WHEN qid % 3 = 0 AND lang = 'en' AND second_word = '' THEN false ELSE true END AS reuse FROM wide"


def b8_fallbacks(d: Spark) -> str:
    """The first of ordered caches that holds the key."""
    return "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('label:', cast(l.quality AS string)) WHEN b.item_id IS NOT NULL THEN concat('bench:', cast(b.item_id AS string)) WHEN p.page_id IS NOT NULL THEN concat('page:', cast(p.page_id AS string)) ELSE 'none' END AS origin FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id"


def b9_merge(d: Spark) -> str:
    """Batches merged by key; the later batch overwrites."""
    return "WITH b AS (SELECT 1 AS batch, o_custkey AS k, max(o_orderkey) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT 2, o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC) AS r FROM b) SELECT k, x, cast(batch AS bigint) AS batch FROM r WHERE r = 1"


def b10_manifest(d: Spark) -> str:
    """Pages as text with content hashes; content counts as a passage from 20 characters on."""
    body = t.tidy(d, d.rep(d.rep("html", r"(?s)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " "))
    return f"WITH s AS (SELECT page_id, url, {body} AS body FROM pages) SELECT page_id, url, {d.sha('body')} AS sha, length(body) > 20 AS passage FROM s"


def t26_sources(d: Spark) -> str:
    return f"SELECT page_id, {d.rep(d.rep('url', '^.*/', ''), '([.]html?|_predictions)$')} AS stem FROM pages"


def t35_by_type(d: Spark) -> str:
    return f"{_with(d, v.candidates(d))}, k AS (SELECT qid, lang, CASE WHEN {t.bad_evaluation(d, 'second_word')} AND first_word <> '' THEN first_word ELSE second_word END AS answer FROM wide) SELECT lang, cast(count(*) AS bigint) AS n, cast(sum({t.n_words(d, 'answer')}) AS bigint) AS words FROM k GROUP BY lang"


def t11_decision(d: Spark) -> str:
    return "SELECT source, CASE WHEN 100 * avg(cast(quality AS double)) >= 60 THEN 'proceed' WHEN 100 * avg(cast(quality AS double)) >= 50 THEN 'optimize' ELSE 'reevaluate' END AS decision FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"


def t12_overlong(d: Spark) -> str:
    return f"SELECT doc_id, substring(text, 1, 100) AS head FROM documents WHERE doc_id >= 50 AND {t.n_words(d, 'text')} > 8"


def t33_confidence(d: Spark) -> str:
    return "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS rank_ FROM events"


def k11_repairs(d: Spark) -> str:
    """Attempt, outcome and counts of repairs over a user's history."""
    return "SELECT user_id, count(*) > 0 AS attempted, cast(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS bigint) AS added, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'repaired' ELSE 'residual' END AS outcome FROM events GROUP BY user_id"


QUERIES = (g21_consensus, g22_groups, g23_ceiling, n8_agreement, n2_context, n3_challenger, n5_best_iteration, n12_overlay, n16_alternatives, t34_rules, f1_gold_join, f5_overlap, f6_resume, i1_union, i2_sets, i3_multiset, i4_pool, h4_dedup, t1_shards, t4_ordered_merge, t6_bodies, b3_export, b6_cache_keys, b7_reuse, b8_fallbacks, b9_merge, b10_manifest, t26_sources, t35_by_type, t11_decision, t12_overlong, t33_confidence, k11_repairs)
