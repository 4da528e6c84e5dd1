"""Text, predicate, reshaping and retrieval plans."""

from __future__ import annotations

from veritrail.functions import classify as c
from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import views as v


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


def j1_normalized(d: Spark) -> str:
    return f"SELECT doc_id, {d.sha(t.normalized(d, 'text'))} AS normalized_sha, cast(length({t.normalized(d, 'text')}) AS bigint) AS n FROM documents"


def j2_scores(d: Spark) -> str:
    """Exact match and token F1 in both conventions for two empty answers."""
    return f"""{_with(d, v.pairs(d))}, kept AS (SELECT qid, pred, gold, {t.tokens(d, "pred")} AS p, {t.tokens(d, "gold")} AS g FROM pairs)
  SELECT qid, cast({t.exact(d, "pred", "gold")} AS bigint) AS em, {t.f1(d, "p", "g")} AS f1, {t.f1(d, "p", "g", 1.0)} AS f1_empty_is_one FROM kept"""


def j4_keys(d: Spark) -> str:
    return f"""{_with(d, v.pairs(d))} SELECT qid, {t.sorted_key(d, "gold")} AS sorted_key, {t.entity_name(d, "gold")} AS entity_name, {t.entity_key(d, "gold")} AS entity_key, {t.surface_key(d, "gold")} AS surface_key,
  {t.compact(d, "gold")} AS compact, {t.unmarked(d, "gold")} AS unmarked FROM pairs"""


def d1_bad_answers(d: Spark) -> str:
    return f"{_with(d, v.pairs(d))} SELECT qid, {t.bad_evaluation(d, 'pred')} AS bad_evaluation, {t.bad_pipeline(d, 'pred')} AS bad_pipeline, {t.bad_dual(d, 'pred')} AS bad_dual FROM pairs"


def d5_minor_alias(d: Spark) -> str:
    """Close surfaces: at most four tokens apart, one within the other as text or as tokens."""
    p, g = t.normalized(d, "pred"), t.normalized(d, "gold")
    near = "abs({0} - {1}) <= 4".format(d.size("p"), d.size("g"))
    return f"""{_with(d, v.pairs(d))}, kept AS (SELECT qid, {p} AS pn, {g} AS gn, {t.tokens(d, "pred")} AS p, {t.tokens(d, "gold")} AS g FROM pairs)
  SELECT qid, CASE WHEN pn = '' OR gn = '' OR pn = gn THEN true ELSE {near} AND (contains(pn, gn) OR contains(gn, pn) OR {t.subset(d, "p", "g")} OR {t.subset(d, "g", "p")}) END AS alias_or_same,
  CASE WHEN pn = '' OR gn = '' OR pn = gn THEN false ELSE {near} AND (contains(pn, gn) OR contains(gn, pn) OR {t.subset(d, "p", "g")} OR {t.subset(d, "g", "p")}) END AS alias_only FROM kept"""


def d6_grounded(d: Spark) -> str:
    """Whether an answer stands in its document, as text or by three quarters of its tokens."""
    return f"""{_with(d, v.pairs(d))}, kept AS (SELECT p.qid, {t.normalized(d, "p.pred")} AS pn, {t.tokens(d, "p.pred")} AS pt, {t.normalized(d, "x.text")} AS evidence, {t.tokens(d, "x.text")} AS et FROM pairs p JOIN documents x ON x.doc_id = CASE WHEN p.qid < 0 THEN -1 - p.qid ELSE p.qid + 1 END)
  SELECT qid, pn <> '' AND (pn IN ('yes', 'no') OR contains(evidence, pn) OR ({t.contains_token_share(d, "pt", "et")}) >= 0.75) AS grounded, round({t.contains_token_share(d, "pt", "et")}, 4) AS share FROM kept"""


def d7_quotes(d: Spark) -> str:
    """Quotes of at least 16 compact characters that stand in the compacted evidence."""
    alnum = lambda x: d.rep(f"lower({x})", "[^a-z0-9]+")
    return f"""{_with(d, v.pairs(d))} SELECT qid, length({alnum("pred")}) >= 16 AND contains({alnum("gold")}, {alnum("pred")}) AS verbatim FROM pairs"""


def d8_constraints(d: Spark) -> str:
    """Up to four distinct quoted spans of 3 to 80 characters and at most six words; all must stand in the evidence."""
    spans = d.slice(d.filter(d.all("html", '="([^"]{3,80})"', 1), "s", f"{t.n_words(d, 's')} <= 6"), "1", "4")
    return f"SELECT page_id, cast({d.size(spans)} AS bigint) AS n_spans, {d.size(d.filter(spans, 's', 'NOT contains(html, s)'))} = 0 AS covered FROM pages"


def k1_question_types(d: Spark) -> str:
    return f"""{_with(d, v.questions(d))} SELECT qid, {c.answer_type(d, "question")} AS answer_type, {c.question_type(d, "question")} AS question_type, cast({c.least_edges(d, "question")} AS bigint) AS least_edges FROM questions"""


def k3_node_fits(d: Spark) -> str:
    kinds = ("award", "location", "country", "date", "number", "person", "entity")
    return "SELECT p_partkey, " + ", ".join(f"{c.node_fits(d, 'p_name', d.lit(k))} AS fits_{k}" for k in kinds) + " FROM part"


def c11_casts(d: Spark) -> str:
    """Loose booleans and numbers: what doesn't parse is false and 0."""
    n = d.group("props", '"k": *([0-9]+)', 1)
    return f"SELECT event_id, {c.loose_bool(d, n)} AS flag, coalesce({d.number(n)}, {d.number('event_type')}, cast(0 AS double)) AS number, coalesce({d.number(n)}, cast(0 AS double)) > 0 AS positive FROM events"


def c2_passages(d: Spark) -> str:
    """Titled passages and their sentences, with places."""
    sentences = d.all("text", r"[^.!?\n]+[.!?]*")
    return f"""WITH s AS (SELECT doc_id, source, {d.filter(d.transform(sentences, "x", "trim(x)"), "x", "x <> ''")} AS sentences FROM documents)
  SELECT doc_id, {d.size("sentences")} AS n, {d.sha(f"concat(source, ': ', {d.joined('sentences', ' ')})")} AS passage_sha FROM s"""


def c3_sentences(d: Spark) -> str:
    sentences = d.filter(d.transform(d.all("text", r"[^.!?\n]+[.!?]*"), "x", "trim(x)"), "x", "x <> ''")
    return f"""WITH s AS (SELECT item_id, {sentences} AS sentences FROM benchmark)
  SELECT item_id, cast(sentence_at AS bigint) AS place, concat('item ', cast(item_id AS string), ': ', sentence) AS sentence FROM s, {d.placed("sentences", "sentence")}"""


def c5_titles(d: Spark) -> str:
    """Title and body at the first colon; without one the title is made of the id."""
    return f"SELECT doc_id, CASE WHEN contains(text, ':') THEN trim({d.group('text', '^([^:]*):', 1)}) ELSE concat('passage_', cast(doc_id AS string)) END AS title, {d.sha(f'trim({d.rep("text", "^[^:]*:")})')} AS body_sha FROM documents"


def c7_file_ids(d: Spark) -> str:
    x = d.rep(d.rep("url", "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$")
    return f"SELECT page_id, coalesce(nullif(substring({x}, 1, 140), ''), concat('page_', cast(page_id AS string))) AS file_id FROM pages"


def c8_fields(d: Spark) -> str:
    """First present against first truthy field, and null words cleansed."""
    clean = lambda x: f"CASE WHEN lower(trim({x})) IN ('null', 'none', 'nan') THEN '' ELSE {x} END"
    return f"{_with(d, v.candidates(d))} SELECT qid, first_word AS present_first, coalesce(nullif({clean('second_word')}, ''), nullif({clean('first_word')}, ''), lang) AS truthy_first, {clean('last_word')} AS cleansed FROM wide"


def c15_unpivot(d: Spark) -> str:
    return f"{_with(d, v.candidates(d))} SELECT qid, src, field, value, {t.normalized(d, 'value')} AS norm FROM candidates WHERE {t.normalized(d, 'value')} <> ''"


def c16_lists(d: Spark) -> str:
    """Elements of piped lists, without labels and null words."""
    items = d.filter(d.transform(d.split("text", r" \|{1,2} "), "x", f"trim({d.rep('x', '^[a-z_]+: ')})"), "x", "x <> '' AND lower(x) NOT IN ('null', 'none', 'nan')")
    return f"WITH s AS (SELECT doc_id, {items} AS items FROM documents WHERE contains(text, ' | ')) SELECT doc_id, cast(item_at AS bigint) AS place, item FROM s, {d.placed('items', 'item')}"


def c14_flattened(d: Spark) -> str:
    """Lists as piped text with counts, the first five only."""
    w = t.words(d, "text")
    return f"SELECT doc_id, {d.joined(d.slice(w, '1', '5'), ' || ')} AS first_five, {d.size(w)} AS n FROM documents"


def c20_evidence(d: Spark) -> str:
    return f"{_with(d, v.kg(d))} SELECT h, {d.sha('min(r)')} AS r_sha, cast(count(*) AS bigint) AS n, min(concat(h, ' --', r, '--> ', t)) AS first_line FROM triples GROUP BY h"


def j11_options(d: Spark) -> str:
    """Options of a comparison question and the longest one that an answer names."""
    q = d.rep("concat('Which film came first, ', pred, ' or ', gold, '?')", r"\?$")
    tail = f"trim({d.rep('q', '^[^,]*,')})"
    left, right = d.group("tail", "^(.*) or .*$", 1), d.group("tail", "^.* or (.*)$", 1)
    edge = lambda x: t.edged(d, x, " ?.,;:\"'`")
    meets = lambda k: f"(answer_key <> '' AND {k} <> '' AND (contains({k}, answer_key) OR contains(answer_key, {k})))"
    return f"""{_with(d, v.pairs(d))}, asked AS (SELECT qid, pred, {q} AS q FROM pairs WHERE pred <> '' AND gold <> ''), tailed AS (SELECT qid, pred, {tail} AS tail FROM asked),
  options AS (SELECT qid, pred, {edge(left)} AS a, {edge(right)} AS b FROM tailed), keyed AS (SELECT qid, pred, a, b, {t.surface_key(d, "a")} AS ka, {t.surface_key(d, "b")} AS kb, {t.surface_key(d, "pred")} AS answer_key FROM options)
  SELECT qid, a, b, CASE WHEN {meets("ka")} AND (NOT {meets("kb")} OR length(ka) > length(kb) OR (length(ka) = length(kb) AND a >= b)) THEN a WHEN {meets("kb")} THEN b ELSE pred END AS chosen FROM keyed"""


def j14_titles(d: Spark) -> str:
    """Person titles and award years stripped."""
    n = t.n_words(d, "x")
    person = "CASE WHEN {0} >= 3 THEN {1} ELSE x END".format(n, f"trim({d.rep('x', '^(Colonel|Count|Air Commodore|Maharaja|Grand Prince) ')})")
    award = d.rep("x", r"\s+[0-9]{4}$")
    return f"""WITH s AS (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'Colonel ' WHEN 1 THEN 'Grand Prince ' WHEN 2 THEN 'International ' ELSE '' END, p_name, CASE WHEN p_partkey % 3 = 0 THEN ' Award 2015' ELSE '' END) AS x FROM part)
  SELECT p_partkey, {person} AS person, CASE WHEN {d.starts(award, "'International '")} AND contains({award}, 'Award') THEN {d.rep(award, '^International ')} ELSE {award} END AS award FROM s"""


def j16_final_line(d: Spark) -> str:
    """The last line, and the last that starts with a mark if there is one."""
    lines = d.filter(d.transform(d.split("text", r"\n"), "x", "trim(x)"), "x", "x <> ''")
    marked = d.filter("lines", "x", d.starts("x", "'The'"))
    return f"WITH s AS (SELECT doc_id, {lines} AS lines FROM documents) SELECT doc_id, {d.sha(f'coalesce({d.at(marked, -1)}, {d.at("lines", -1)})')} AS final_sha FROM s"


def j17_steps(d: Spark) -> str:
    lines = d.split("text", r"\n")
    pick = lambda head: d.at(d.filter(lines, "x", d.starts("x", d.lit(head))), -1)
    return f"SELECT conv_id, turn, coalesce({pick('THOUGHT:')}, '') AS thought, coalesce({pick('SEARCH_QUERY:')}, '') AS query_, coalesce({pick('FINAL_ANSWER:')}, text) AS final_answer FROM conversations"


def j19_triples(d: Spark) -> str:
    """Triples written as text and parsed again."""
    rx = "^(.+?) -- (.+?) --> (.+)$"
    return f"""{_with(d, v.kg(d))}, coded AS (SELECT DISTINCT concat('  ', h, ' -- ', r, ' --> ', t, ' ') AS line FROM triples WHERE r <> 'contains')
  SELECT {", ".join(f"{d.group('trim(line)', rx, i)} AS {n}" for i, n in ((1, "h"), (2, "r"), (3, "t")))} FROM coded"""


def j20_paren_triples(d: Spark) -> str:
    rx = r"^\((.+?), *(.+?), *(.+?)\)$"
    return f"""WITH s AS (SELECT s_suppkey, concat('(', s_name, ', in,  ', cast(s_nationkey AS string), ')') AS line FROM supplier)
  SELECT s_suppkey, {", ".join(f"{d.group('line', rx, i)} AS {n}" for i, n in ((1, "h"), (2, "r"), (3, "t")))} FROM s"""


def j22_entities(d: Spark) -> str:
    """Runs of capitalized words that aren't question words, first occurrences joined in order of text."""
    runs = d.all("text", "[A-Z][a-z]+(?: [A-Z][a-z]+)*")
    return f"SELECT conv_id, turn, {d.joined(d.sorted(d.distinct(d.filter(runs, 'x', "lower(x) NOT IN ('what', 'when', 'where', 'who', 'which', 'whom', 'whose', 'why', 'how', 'the', 'is', 'are', 'a', 'an')"))), ' | ')} AS entities FROM conversations"


def j24_relations(d: Spark) -> str:
    """Relations match if one's tokens are within the other's or half of all are shared."""
    a, b = "pt", "gt"
    union = f"({d.size(d.distinct(a))} + {d.size(d.distinct(b))} - {d.size(d.common(a, b))})"
    return f"""{_with(d, v.pairs(d))}, k AS (SELECT qid, {t.tokens(d, "pred")} AS pt, {t.tokens(d, "gold")} AS gt FROM pairs)
  SELECT qid, {d.size(a)} > 0 AND {d.size(b)} > 0 AND ({t.subset(d, a, b)} OR {t.subset(d, b, a)} OR cast({d.size(d.common(a, b))} AS double) / {union} >= 0.5) AS same_relation FROM k"""


def j25_clean(d: Spark) -> str:
    x = d.rep(t.edged(d, "gold", " \"'`"), r"(?i)^(the answer is|answer is|answer:|it is|that is) +")
    return f"{_with(d, v.pairs(d))} SELECT qid, {d.rep(x, '[.,;:!? ]+$')} AS cleaned FROM pairs"


def n1_gate(d: Spark) -> str:
    """Seven reasons to take a postprocessed answer."""
    cur, post = "cur", "post"
    ctok, ptok = t.tokens(d, cur), t.tokens(d, post)
    expansion = f"(kind IN ('person', 'comparison', 'entity') AND {d.size(ctok)} > 0 AND {t.subset(d, ctok, ptok)} AND NOT {t.subset(d, ptok, ctok)} AND {t.n_words(d, post)} <= {t.n_words(d, cur)} + 2 AND contains(lower({post}), lower({cur})))"
    short = f"({t.compact(d, post)} NOT IN ('', 'yes', 'no') AND {t.balanced(d, post)} AND {t.n_words(d, post)} <= 6)"
    mismatch = f"(kind <> 'yesno' AND {t.compact(d, cur)} IN ('yes', 'no', 'wait', 'but', 'alternative') AND {short})"
    return f"""{_with(d, v.pairs(d))}, k AS (SELECT qid, CASE qid % 5 WHEN 0 THEN 'no' WHEN 1 THEN gold WHEN 2 THEN '' ELSE pred END AS cur, gold AS post, CASE qid % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'yesno' ELSE 'choice' END AS kind FROM pairs)
  SELECT qid, kind, post <> '' AND NOT {t.bad_pipeline(d, post)} AND ({t.bad_pipeline(d, cur)} OR {t.sorted_key(d, post)} = {t.sorted_key(d, cur)} OR {t.n_words(d, post)} < {t.n_words(d, cur)}
  OR (kind = 'choice' AND lower(trim(post)) NOT IN ('yes', 'no')) OR (kind = 'yesno' AND {t.compact(d, post)} IN ('yes', 'no') AND {t.bad_pipeline(d, cur)}) OR {expansion} OR {mismatch}) AS taken FROM k"""


def n4_dual_path(d: Spark) -> str:
    """Which of a graph answer and a context answer stands, and why."""
    return f"""{_with(d, v.pairs(d), v.questions(d))}, k AS (SELECT p.qid, p.pred AS kg, p.gold AS ctx, cast(p.qid % 10 AS double) / 10 AS score, cast((p.qid * 7) % 10 AS double) / 10 AS conf, q.question FROM pairs p JOIN questions q ON q.conv_id = p.qid % 50 AND q.turn = 1),
  j AS (SELECT *, {t.bad_dual(d, "kg")} AS kg_bad, {t.bad_dual(d, "ctx")} AS ctx_bad, {c.question_type(d, "question")} AS kind FROM k),
  r AS (SELECT *, CASE WHEN kg_bad AND NOT ctx_bad THEN 'context_fallback' WHEN ctx_bad AND NOT kg_bad THEN 'kg' WHEN kg_bad THEN 'kg_both_bad' WHEN kind = 'yesno' AND {d.rep("lower(trim(ctx))", "[.]+$")} IN ('yes', 'no') THEN 'context_yesno'
  WHEN kind = 'comparison' AND {t.n_words(d, "ctx")} <= 8 THEN 'context_comparison' WHEN score >= 0.6 THEN 'kg_high_score' WHEN conf >= 0.7 AND score < 0.4 THEN 'context_high_conf' ELSE 'kg_default' END AS origin FROM j)
  SELECT qid, origin, CASE WHEN {d.starts("origin", "'context'")} THEN ctx ELSE kg END AS answer FROM r"""


def n17_verification(d: Spark) -> str:
    """Clamped weighted score of three parts; one half where a part is missing."""
    part = lambda x: f"least(cast(1 AS double), greatest(cast(0 AS double), coalesce({x}, cast(0.5 AS double))))"
    total = f"(0.4 * {part('nullif(value, 0)')} + 0.3 * {part('value / 10')} + 0.3 * {part('value - 1')})"
    return f"SELECT event_id, round({total}, 4) AS score, {total} >= 0.5 AS pass FROM events"


def _bm25(d: Spark, queries: str, corpus: str, words) -> str:
    """Scores of (qid, pid): query terms count as often as they stand in the query."""
    return f"""corpus AS ({corpus}), asks AS ({queries}),
  worded AS (SELECT pid, w, cast({d.size("w")} AS double) AS dl FROM (SELECT pid, {words("body")} AS w FROM corpus) x), doc_terms AS (SELECT pid, term, dl, cast(count(*) AS double) AS tf FROM worded, {d.rows("w", "term")} GROUP BY pid, term, dl),
  totals AS (SELECT cast(count(*) AS double) AS n, sum(dl) / count(*) AS avgdl FROM worded),
  raw_idf AS (SELECT term, ln(max(n) - count(*) + 0.5) - ln(count(*) + cast(0.5 AS double)) AS idf FROM doc_terms JOIN totals ON true GROUP BY term), mean_idf AS (SELECT avg(idf) AS m FROM raw_idf),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM raw_idf JOIN mean_idf ON true),
  ask_terms AS (SELECT qid, term, cast(count(*) AS double) AS qtf FROM asks, {d.rows(words("question"), "term")} GROUP BY qid, term),
  scores AS (SELECT a.qid, x.pid, round(sum(a.qtf * i.idf * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * x.dl / avgdl))), 4) AS score FROM ask_terms a JOIN doc_terms x ON a.term = x.term JOIN idf i ON i.term = a.term JOIN totals ON true GROUP BY a.qid, x.pid)"""


_ITEMS = "SELECT item_id AS pid, text AS body FROM benchmark"


#: Questions are user turns, whole; their number tells them apart.
_ASKS = "SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'"


def _lowered(d: Spark):
    return lambda x: d.filter(d.split(f"lower({x})", r"\s+"), "w", "w <> ''")


def _alnum(d: Spark):
    return lambda x: d.all(f"lower({x})", "[a-z0-9]+")


def m1_bm25_topk(d: Spark) -> str:
    """The five best passages of a positive score for each question."""
    return f"""{_with(d, _bm25(d, _ASKS, _ITEMS, _lowered(d)))}, ranked AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM scores WHERE score > 0)
  SELECT qid, pid, score, cast(r AS bigint) AS r FROM ranked WHERE r <= 5"""


def m2_bm25_alnum(d: Spark) -> str:
    """The same over runs of letters and digits; the first hit is kept whatever its score."""
    return f"""{_with(d, _bm25(d, _ASKS, _ITEMS, _alnum(d)))}, ranked AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM scores)
  SELECT qid, pid, score, cast(r AS bigint) AS r FROM ranked WHERE r <= 8 AND (r = 1 OR score > 0)"""


def e5_unseen(d: Spark) -> str:
    """Top passages that a question hasn't seen before."""
    return f"""{_with(d, _bm25(d, _ASKS, _ITEMS, _lowered(d)))}, seen AS (SELECT qid, pid FROM scores WHERE (qid + pid) % 3 = 0),
  fresh AS (SELECT s.* FROM scores s LEFT ANTI JOIN seen x ON s.qid = x.qid AND s.pid = x.pid), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM fresh)
  SELECT qid, pid, score FROM ranked WHERE r <= 5 AND (r = 1 OR score > 0)""".replace("LEFT ANTI JOIN" if d.name == "duck" else "\0", "ANTI JOIN")


def e6_overfetch(d: Spark) -> str:
    """Rank four times as many, keep scores over a floor, then cut."""
    return f"""{_with(d, _bm25(d, _ASKS, _ITEMS, _lowered(d)))}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM scores),
  kept AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY r) AS k FROM ranked WHERE r <= 20 AND score > 0.5) SELECT qid, pid, score FROM kept WHERE k <= 5"""


def e4_adaptive(d: Spark) -> str:
    """All passages of a group of at most ten, else the five longest."""
    return """WITH p AS (SELECT doc_id, source, n_chars, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
  SELECT doc_id, source, CASE WHEN n <= 10 THEN 'all' ELSE 'top' END AS why FROM p WHERE n <= 10 OR r <= 5"""


def m3_overlap(d: Spark) -> str:
    """Shared terms of a question and a passage, three more for a candidate inside."""
    return f"""WITH asks AS ({_ASKS}), a AS (SELECT qid, {d.distinct(t.tokens(d, "question"))} AS q, coalesce({d.at(t.words(d, "question"), 2)}, '') AS candidate FROM asks),
  b AS (SELECT item_id, text, {d.distinct(t.tokens(d, "text"))} AS p FROM benchmark), terms AS (SELECT qid, candidate, term FROM a, {d.rows("q", "term")}), posts AS (SELECT item_id, term FROM b, {d.rows("p", "term")}),
  shared AS (SELECT qid, candidate, item_id, count(*) AS n FROM terms JOIN posts ON terms.term = posts.term GROUP BY qid, candidate, item_id)
  SELECT qid, s.item_id, cast(n + CASE WHEN candidate <> '' AND contains(b.text, candidate) THEN 3 ELSE 0 END AS bigint) AS score FROM shared s JOIN b ON s.item_id = b.item_id"""


def e7_budget(d: Spark) -> str:
    """Passages of a group in order until a budget of characters; the last is cut."""
    return """WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM documents)
  SELECT doc_id, source, cast(least(n_chars, 20000 - (total - n_chars)) AS bigint) AS taken, cast(total AS bigint) AS total FROM r WHERE total - n_chars < 20000"""


def t17_numbered(d: Spark) -> str:
    """Numbered lines until the first that doesn't fit."""
    return """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, least(n_chars, 900) + 5 AS cost FROM documents),
  c AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM r) SELECT doc_id, concat('[', cast(i AS string), ']') AS label, cast(total AS bigint) AS total FROM c WHERE total <= 12000"""


def e9_top_fraction(d: Spark) -> str:
    """The fifth of the rows of the highest risk; of equal ones the higher id as text."""
    r = v.placed("r", "audit", "k.risk_score DESC, cast(k.qid AS string) DESC", "concat(cast(risk_score AS string), ' ', substring(cast(qid AS string), 1, 3))", "bucket_ DESC")
    return f"{_with(d, v.audit(d), r)} SELECT qid, cast(risk_score AS bigint) AS risk_score FROM r WHERE pos <= ceil(total * cast(0.2 AS double))"


def e11_balanced(d: Spark) -> str:
    """Exactly n rows of each type, by a seeded arithmetic order that both engines share."""
    return """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 123) % 100003, doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 25"""


def e12_quota(d: Spark) -> str:
    """Quotas by label, capped by what there is; what is short goes to the labels with most left."""
    return f"""{_with(d, v.audit(d))}, have AS (SELECT gap, count(*) AS n, CASE gap WHEN 'complete' THEN 34 WHEN 'missing_entities' THEN 35 WHEN 'disconnected' THEN 20 ELSE 11 END AS quota FROM audit GROUP BY gap),
  capped AS (SELECT gap, n, least(n, quota) AS q, n - least(n, quota) AS spare FROM have), short AS (SELECT greatest(0, 100 - sum(q)) AS missing FROM capped),
  filled AS (SELECT gap, n, q + greatest(0, least(spare, missing - coalesce(sum(spare) OVER (ORDER BY spare DESC, gap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS q FROM capped JOIN short ON true),
  ranked AS (SELECT qid, gap, row_number() OVER (PARTITION BY gap ORDER BY (qid * 7919 + 77) % 100003, qid) AS r FROM audit)
  SELECT ranked.qid, ranked.gap FROM ranked JOIN filled ON ranked.gap = filled.gap WHERE r <= q"""


def e14_first_distinct(d: Spark) -> str:
    """The first values in order, one for each normalized form, with the labels of all their occurrences."""
    if d.name == "spark":
        labels = "array_join(transform(array_sort(collect_list(struct(pos, src))), x -> x.src), '|')"
        first = "min_by(value, pos)"
    else:
        labels, first = "string_agg(src, '|' ORDER BY pos)", "arg_min(value, pos)"
    return f"""{_with(d, v.candidates(d))}, n AS (SELECT qid, src, value, pos, {t.normalized(d, "value")} AS norm FROM candidates), g AS (SELECT qid, norm, min(pos) AS pos, {first} AS value, {labels} AS labels FROM n WHERE norm <> '' GROUP BY qid, norm),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM g) SELECT qid, value, labels, cast(r AS bigint) AS r FROM r WHERE r <= 4"""


QUERIES = (j1_normalized, j2_scores, j4_keys, d1_bad_answers, d5_minor_alias, d6_grounded, d7_quotes, d8_constraints, k1_question_types, k3_node_fits, c11_casts, c2_passages, c3_sentences, c5_titles, c7_file_ids, c8_fields, c15_unpivot, c16_lists, c14_flattened, c20_evidence, j11_options, j14_titles, j16_final_line, j17_steps, j19_triples, j20_paren_triples, j22_entities, j24_relations, j25_clean, n1_gate, n4_dual_path, n17_verification, m1_bm25_topk, m2_bm25_alnum, e5_unseen, e6_overfetch, e4_adaptive, m3_overlap, e7_budget, t17_numbered, e9_top_fraction, e11_balanced, e12_quota, e14_first_distinct)
