"""Further plans: probes, gates, cleaning, verification and context shapes."""

from __future__ import annotations

from veritrail.functions import classify as c
from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import audit as a
from veritrail.plans import views as v


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


def k6_probe_states(d: Spark) -> str:
    """Four states, fallback first; and which of two selection flags holds."""
    return f"""{_with(d, v.audit(d))} SELECT qid, CASE WHEN fallback_steps <> '' THEN 'fallback' WHEN complete AND repair_steps <> '' THEN 'repaired' WHEN complete THEN 'checked' ELSE 'residual' END AS probe_state,
  selected OR n_chars % 2 = 0 AS either_flag, CASE WHEN n_chars % 3 = 0 THEN n_chars % 2 = 0 ELSE selected END AS newer_flag FROM audit"""


def k9_labels(d: Spark) -> str:
    return f"{_with(d, v.audit(d))} SELECT qid, CASE WHEN raw_gap = '' AND NOT complete THEN 'unlabeled_incomplete' WHEN raw_gap = '' THEN 'complete' ELSE raw_gap END AS label FROM audit"


def k10_reviews(d: Spark) -> str:
    return f"{_with(d, v.audit(d), a._reviews(d))} SELECT qid, gap, a AS strict, b AS support, c AS cautious FROM reviews"


def k12_variants(d: Spark) -> str:
    """Ablation, variant and iterations with nested defaults."""
    return "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'variant' END, ''), 'default') AS variant FROM events"


def k13_sources(d: Spark) -> str:
    """Kind of a source by its name and the weight of a field."""
    name = "concat(event_type, CASE user_id % 7 WHEN 0 THEN '_candidate_choice' WHEN 1 THEN '_contextual_prior_v2' WHEN 2 THEN '_guarded_judge' WHEN 3 THEN '_evidence_reader_support_first' WHEN 4 THEN '_evidence_reader' WHEN 5 THEN '_final_verifier' ELSE '' END)"
    kinds = (("candidate_choice", "choice"), ("contextual_prior_v2", "prior"), ("guarded_judge", "guarded"), ("evidence_reader_support_first", "support_first"), ("evidence_reader", "reader"), ("final_verifier", "verifier"), ("meta_selector", "meta"))
    kind = "CASE " + " ".join(f"WHEN contains(s, '{m}') THEN '{k}'" for m, k in kinds) + " ELSE 'other' END"
    bonus = "CASE kind WHEN 'choice' THEN 2.0 WHEN 'prior' THEN 1.5 WHEN 'reader' THEN 1.0 WHEN 'support_first' THEN 1.0 WHEN 'verifier' THEN 0.8 WHEN 'guarded' THEN 0.7 WHEN 'meta' THEN 0.3 ELSE 0.0 END"
    weight = "CASE WHEN contains(s, 'contextual_prior_v2') THEN 6.0 WHEN contains(s, 'candidate_choice') THEN 4.0 WHEN contains(s, 'reader_support') THEN 3.0 ELSE 1.0 END"
    return f"WITH n AS (SELECT event_id, {name} AS s FROM events), k AS (SELECT event_id, s, {kind} AS kind FROM n) SELECT event_id, kind, round(cast({weight} + {bonus} AS double), 4) AS weight FROM k"


def d4_surfaces(d: Spark) -> str:
    """Surfaces that can't be answers: empty, over twelve tokens or 180 characters, or of a form."""
    low = "lower(trim(pred))"
    return f"{_with(d, v.pairs(d))} SELECT qid, {t.normalized(d, 'pred')} = '' OR {d.size(t.tokens(d, 'pred'))} > 12 OR length({low}) > 180 OR {t.starts_any(d, low, ('{', '- '))} OR {t.has_any(d, low, t.BAD_EVALUATION)} AS bad FROM pairs"


def d9_conformance(d: Spark) -> str:
    """Whether an answer is of the kind its question asks for, and why not."""
    q = "lower(question)"
    return f"""{_with(d, v.questions(d))}, k AS (SELECT qid, question, {c.question_type(d, "question")} AS kind, {d.joined(d.slice(t.words(d, "question"), "1", "2"), " ")} AS proposed FROM questions), n AS (SELECT *, {t.normalized(d, "proposed")} AS p FROM k)
  SELECT qid, CASE WHEN kind = 'yesno' AND p NOT IN ('yes', 'no') THEN 'yesno_not_binary' WHEN {d.starts(q, "'how many'")} AND {d.rlike("trim(proposed)", "^(1[0-9]{3}|20[0-9]{2})$")} THEN 'how_many_year'
  WHEN contains({q}, 'which president') AND NOT {d.rlike("lower(proposed)", "[0-9]{1,2}(st|nd|rd|th)")} THEN 'president_without_ordinal' WHEN kind = 'number_date' AND NOT {d.rlike("proposed", "[0-9]")} THEN 'number_date_without_number'
  WHEN kind = 'location' AND {d.rlike("proposed", "(University|Airline|Company|Corporation|Inc|Ltd)")} THEN 'location_org_like' ELSE 'qtype_ok' END AS reason FROM n"""


def d11_targets(d: Spark) -> str:
    """Reasons to look at an answer again, in fixed order."""
    reasons = (("low_rule", "qid % 5 = 0"), ("bad_current", t.bad_evaluation(d, "first_word")), ("yesno_non_yesno", "qid % 3 = 0 AND lower(first_word) NOT IN ('yes', 'no')"), ("comparison_long", f"{t.n_words(d, 'opening')} > 2"))
    listed = d.filter(d.array(*[f"CASE WHEN {x} THEN '{r}' ELSE '' END" for r, x in reasons]), "x", "x <> ''")
    return f"{_with(d, v.candidates(d))} SELECT qid, {d.joined(listed, '|')} AS reasons, {d.size(listed)} AS n FROM wide"


def d12_classes(d: Spark) -> str:
    """Rows whose diagnosis is of a set."""
    return f"{_with(d, v.audit(d))}, k AS (SELECT qid FROM audit WHERE state IN ('unrepaired_incomplete', 'fallback_incomplete')) SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM k WHERE k.qid = d.doc_id)"


def e1_slice(d: Spark) -> str:
    """Rows 20 to 69 in input order."""
    return "WITH f AS (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 70), p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM f) SELECT doc_id, lang, cast(pos AS bigint) AS pos FROM p WHERE pos >= 20 AND pos < 70"


def e8_priorities(d: Spark) -> str:
    return f"{_with(d, v.audit(d))}, p AS (SELECT qid, CASE WHEN NOT selected THEN 0 WHEN residual THEN 1 WHEN NOT complete THEN 2 ELSE 3 END AS priority FROM audit), f AS (SELECT * FROM p ORDER BY priority, qid LIMIT 40), r AS (SELECT *, row_number() OVER (ORDER BY priority, qid) AS r FROM f) SELECT qid, cast(priority AS bigint) AS priority, cast(r AS bigint) AS r FROM r WHERE r <= 40"


def e13_seeded(d: Spark) -> str:
    """A seeded sample of 30 positions, in order of position."""
    return "WITH k AS (SELECT conv_id, turn, (conv_id * 131 + turn * 7919 + 123) % 10007 AS draw FROM conversations) SELECT conv_id, turn FROM (SELECT * FROM k ORDER BY draw, conv_id, turn LIMIT 30) x"


def f2_pairwise(d: Spark) -> str:
    """Shared ids of two runs, the type taken from the first."""
    return f"""{_with(d, v.audit(d))}, one AS (SELECT qid, type, em FROM audit WHERE n_chars % 2 = 0 OR selected), two AS (SELECT qid, dataset AS type, CASE WHEN f1 >= 0.5 THEN cast(1 AS double) ELSE cast(0 AS double) END AS em FROM audit WHERE complete)
  SELECT one.type, cast(count(*) AS bigint) AS n, cast(sum(CASE WHEN one.em > two.em THEN 1 ELSE 0 END) AS bigint) AS primary_only, cast(sum(CASE WHEN one.em < two.em THEN 1 ELSE 0 END) AS bigint) AS baseline_only, round(avg(one.em - two.em), 4) AS delta FROM one JOIN two ON one.qid = two.qid GROUP BY one.type"""


def f4_enriched(d: Spark) -> str:
    """Predictions with items and graphs (both must be there) and caches (may be missing)."""
    return f"{_with(d, v.audit(d))} SELECT a.qid, a.state, d.source, CASE WHEN b.item_id IS NULL THEN 'uncached' ELSE 'cached' END AS cache FROM audit a JOIN documents d ON d.doc_id = a.qid LEFT JOIN benchmark b ON b.item_id = a.qid"


def f11_endpoints(d: Spark) -> str:
    """Pairs of an order's parts in nested order, and whether one supplier holds both."""
    if d.name == "spark":
        # Lines of an order meet as one array of parts with their suppliers, so its pairs are made once and never grouped.
        return """WITH p AS (SELECT l_orderkey, l_partkey, array_distinct(collect_list(coalesce(cast(l_suppkey AS string), ''))) AS s FROM lineitem GROUP BY l_orderkey, l_partkey), o AS (SELECT l_orderkey, array_sort(collect_list(struct(l_partkey, s))) AS l FROM p WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL GROUP BY l_orderkey)
  SELECT qid, a.l_partkey AS a, b.l_partkey AS b, arrays_overlap(array_remove(a.s, ''), array_remove(b.s, '')) AS linked FROM (SELECT qid, l, a, explode(filter(l, y -> y.l_partkey > a.l_partkey)) AS b FROM (SELECT l_orderkey AS qid, l, explode(l) AS a FROM o) x) y"""
    return """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) SELECT x.l_orderkey AS qid, x.l_partkey AS a, y.l_partkey AS b, max(CASE WHEN x.l_suppkey = y.l_suppkey THEN 1 ELSE 0 END) = 1 AS linked FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY x.l_orderkey, x.l_partkey, y.l_partkey"""


def g25_same_ids(d: Spark) -> str:
    """Ordered ids of two tables compared by place."""
    a, b = (v.placed(n, t_, "k.doc_id", "floor(doc_id / 4096)") for n, t_ in (("a", "documents"), ("b", "labels")))
    return f"WITH {a}, {b} SELECT cast(count(a.doc_id) AS bigint) AS n_a, cast(count(b.doc_id) AS bigint) AS n_b, cast(sum(CASE WHEN a.doc_id = b.doc_id THEN 1 ELSE 0 END) AS bigint) AS same FROM a FULL OUTER JOIN b ON a.pos = b.pos"


def g27_missing(d: Spark) -> str:
    """Support titles that no context title matches."""
    return "WITH s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 5) SELECT l_orderkey AS qid, cast(sum(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing FROM s LEFT JOIN c ON l_partkey = p_partkey GROUP BY l_orderkey"


def g28_cases(d: Spark) -> str:
    """The highest ranked cases of each type."""
    return f"{_with(d, v.audit(d))}, r AS (SELECT qid, type, em, f1, row_number() OVER (PARTITION BY type ORDER BY em DESC, f1 DESC, risk_score, qid) AS r FROM audit) SELECT qid, type, em, f1 FROM r WHERE r <= 3"


def j9_graph_answers(d: Spark) -> str:
    """A long graph answer cut to yes or no, a conclusion, or its first sentence."""
    text = t.unmarked(d, "answer")
    yesno = d.group("lower(x)", r"(?:^|[^a-z0-9_])(yes|no)(?:$|[^a-z0-9_])", 1)
    therefore = t.edged(d, d.group("x", r"(?i)(?:^|[^A-Za-z0-9_])(?:therefore|thus|so|hence)(?:[:,])?\s*([A-Z][^.!?\n]{0,120})", 1), " .,:;")
    first = t.edged(d, d.rep(d.group("x", r"^([^.!?]*[.!?]?)", 1), r"(?i)^(the answer is|answer:|therefore|thus|so)\s+"), " .,:;")
    starts = t.starts_any(d, "q", ("did ", "does ", "do ", "is ", "are ", "was ", "were ", "has ", "have ", "had ", "can "))
    return f"""{_with(d, v.questions(d))}, j AS (SELECT q.qid, lower(question) AS q, coalesce(a.text, '') AS answer FROM questions q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1), k AS (SELECT qid, q, {text} AS x FROM j)
  SELECT qid, CASE WHEN x = '' THEN '' WHEN {starts} AND {yesno} <> '' THEN {yesno} WHEN {t.starts_any(d, "q", ("which ", "who ", "what "))} AND {therefore} <> '' THEN {therefore} ELSE {first} END AS answer FROM k"""


def j10_clean(d: Spark) -> str:
    """Final answers without wrappers: bullets, connectives, prefixes, dash heads, colon heads and long tails."""
    edges = "\"'`.,:;!?"
    s1 = d.rep(d.rep(t.edged(d, "trim(answer)", edges), r"^\s*[-*]\s+"), r"(?i)^(therefore|thus|so|hence)[,:\s]+")
    s2 = f"CASE WHEN contains(lower(a1), 'shortest exact answer phrase') OR lower(a1) IN ('therefore', 'thus', 'so', 'hence') THEN '' ELSE a1 END"
    head = t.edged(d, d.group("a2", r"^(.*?) (?:—|–|-) ", 1), edges + " ")
    s3 = f"CASE WHEN {head} <> '' AND {t.n_words(d, head)} <= 5 THEN {head} ELSE a2 END"
    s4 = t.edged(d, d.rep("a3", r"(?i)^(the answer is|answer is|answer:|it is|that is) +"), edges)
    colon = f"trim({d.group('a4', '^([^:]*):', 1)})"
    s5 = f"CASE WHEN contains(a4, ':') AND {t.n_words(d, colon)} BETWEEN 1 AND 5 AND lower({colon}) NOT IN ('answer', 'final answer', 'therefore', 'thus', 'so', 'hence') THEN {t.edged(d, colon, edges)} ELSE a4 END"
    raw = "concat(CASE qid % 4 WHEN 0 THEN '- ' WHEN 1 THEN 'Therefore, ' WHEN 2 THEN 'The answer is ' ELSE '' END, gold, CASE qid % 3 WHEN 0 THEN ' - because' WHEN 1 THEN '.' ELSE ': so' END)"
    return f"""{_with(d, v.pairs(d))}, r AS (SELECT qid, {raw} AS answer FROM pairs), w1 AS (SELECT qid, {s1} AS a1 FROM r), w2 AS (SELECT qid, {s2} AS a2 FROM w1), w3 AS (SELECT qid, {s3} AS a3 FROM w2), w4 AS (SELECT qid, {s4} AS a4 FROM w3)
  SELECT qid, {t.edged(d, s5, edges)} AS answer FROM w4"""


def j12_population(d: Spark) -> str:
    """The canonical statement of a population choice, if the evidence holds all its parts."""
    rx = r"(?i)did (.+?) or (.+?) have a population of ([0-9,]+) in ([0-9]{4})"
    g = lambda i: d.group("q", rx, i)
    return f"""WITH p AS (SELECT c_custkey, concat('Did ', c_name, ' or ', c_mktsegment, ' have a population of ', cast(1000 + c_custkey AS string), ' in 2002?') AS q, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_mktsegment) END AS answer,
  concat('the population of ', c_name, ' was ', cast(1000 + c_custkey AS string), ' in 2002') AS evidence FROM customer), s AS (SELECT c_custkey, q, evidence, CASE WHEN {t.surface_key(d, g(1))} = {t.surface_key(d, "answer")} THEN {g(1)} WHEN {t.surface_key(d, g(2))} = {t.surface_key(d, "answer")} THEN {g(2)} ELSE '' END AS chosen FROM p)
  SELECT c_custkey, CASE WHEN chosen <> '' AND contains({t.surface_key(d, "evidence")}, {t.surface_key(d, "chosen")}) AND contains({t.surface_key(d, "evidence")}, {g(4)}) THEN concat('In ', {g(4)}, ', ', chosen, ' had a population of ', {g(3)}, '.') ELSE '' END AS statement FROM s"""


def j13_names(d: Spark) -> str:
    """The longest fuller form of a name in a passage: up to three capitalized words before it."""
    n = d.group("body", "((?:[A-Z][a-z]+ ){1,3})Smith", 1)
    return f"WITH s AS (SELECT p_partkey, concat('Later ', CASE p_partkey % 3 WHEN 0 THEN 'William Dwight ' WHEN 1 THEN 'Ann ' ELSE '' END, 'Smith of ', p_name) AS body FROM part) SELECT p_partkey, CASE WHEN {n} = '' THEN 'Smith' ELSE concat({d.rep(n, '^Later ')}, 'Smith') END AS name FROM s"


def j18_json(d: Spark) -> str:
    """Values of a JSON text behind code fences, empty where it doesn't parse."""
    fenced = "concat('```json ', props, CASE WHEN event_id % 5 = 0 THEN ' trailing' ELSE '' END, ' ```')"
    return f"SELECT event_id, {d.group(d.group(fenced, r'([{][^}]*[}])', 1), '"k": *([0-9]+)', 1)} AS k FROM events"


def l5_directed(d: Spark) -> str:
    """Directed edges to undirected: the first direction and relation of each pair stay."""
    first = "min_by(concat(h, '|', r), concat(h, r, t))" if d.name == "spark" else "arg_min(concat(h, '|', r), concat(h, r, t))"
    return f"{_with(d, v.kg(d))} SELECT least(h, t) AS a, greatest(h, t) AS b, {first} AS kept FROM triples GROUP BY least(h, t), greatest(h, t)"


def l16_gap_place(d: Spark) -> str:
    """Where a chain breaks: endpoints that share no neighbour are disconnected, else bridged."""
    return f"""{_with(d, v.kg(d))}, asked AS (SELECT DISTINCT concat('supplier:', cast(s_suppkey AS string)) AS a, concat('supplier:', cast(s_suppkey + 7 AS string)) AS b FROM supplier), near AS (SELECT h AS x, t AS y FROM triples WHERE r <> 'contains' UNION SELECT t, h FROM triples WHERE r <> 'contains'),
  met AS (SELECT a, b, min(e1.y) AS via FROM asked JOIN near e1 ON e1.x = a JOIN near e2 ON e2.x = b AND e1.y = e2.y GROUP BY a, b) SELECT asked.a, asked.b, CASE WHEN via IS NULL THEN 'disconnected' ELSE 'bridge_gap' END AS gap_type, coalesce(via, '') AS via FROM asked LEFT JOIN met ON asked.a = met.a AND asked.b = met.b"""


def l19_statistics(d: Spark) -> str:
    return f"{_with(d, v.audit(d))} SELECT cast(count(*) AS bigint) AS checks, cast(sum(CASE WHEN complete THEN 1 ELSE 0 END) AS bigint) AS complete_n, {a.rate('complete')} AS complete_rate, {a.rate("repair_steps <> ''")} AS repair_rate FROM audit"


def l22_upserts(d: Spark) -> str:
    """Edges overwritten by later ones of the same ends, and how many changed."""
    return """WITH e AS (SELECT o_custkey AS a, o_orderstatus AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT a, r, cast(n - 1 AS bigint) AS overwritten FROM e WHERE k = 1"""


def l25_recall(d: Spark) -> str:
    """Recall of gold titles among the longest five of each group."""
    return "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, cast(count(*) AS bigint) AS gold_n, round(avg(CASE WHEN r <= 5 THEN cast(1 AS double) ELSE cast(0 AS double) END), 4) AS recall_ FROM r JOIN labels l ON l.doc_id = r.doc_id WHERE quality = 1 GROUP BY source"


def m4_queries(d: Spark) -> str:
    """Retrieval queries of question, current answer and candidates."""
    return f"{_with(d, v.candidates(d))} SELECT qid, concat_ws(' ', nullif(opening, ''), nullif(last_word, ''), nullif(second_word, '')) AS query_ FROM wide"


def m5_evidence(d: Spark) -> str:
    """Evidence by question first, then by candidate; distinct texts, six at most."""
    return """WITH e AS (SELECT source, text, doc_id, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END AS part FROM documents), f AS (SELECT source, text, min(cast(part AS bigint) * 1000000000 + doc_id) AS place FROM e GROUP BY source, text), r AS (SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY place) AS r FROM f)
  SELECT source, place % 1000000000 AS doc_id, cast(r AS bigint) AS r FROM r WHERE r <= 6"""


def o2_counts(d: Spark) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, cast(count(*) AS bigint) AS n FROM {n}" for n in ("documents", "labels", "benchmark", "pages", "conversations"))


def o6_presence(d: Spark) -> str:
    """Required ids that are missing, and stale marks in texts."""
    return "WITH required AS (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark) SELECT r.doc_id, d.doc_id IS NULL AS missing, coalesce(contains(d.text, 'TODO'), false) AS stale FROM required r LEFT JOIN documents d ON d.doc_id = r.doc_id"


def q5_routes(d: Spark) -> str:
    """Local passages alone or with global ones, by mode."""
    return "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'local' WHEN user_id % 2 = 0 THEN 'local+global' ELSE 'global' END AS route FROM events"


def t5_strict(d: Spark) -> str:
    """Only the field that is named counts, without fallback; null words are empty."""
    return f"{_with(d, v.pairs(d))}, k AS (SELECT qid, CASE WHEN lower(trim(pred)) IN ('null', 'none', 'nan') THEN '' ELSE pred END AS response, gold FROM pairs) SELECT qid, cast({t.exact(d, 'response', 'gold')} AS bigint) AS em FROM k"


def t7_identifiers(d: Spark) -> str:
    return f"SELECT page_id, {d.rlike(d.rep('url', '^.*/', ''), '^[A-Za-z_][A-Za-z0-9_]*$')} AS valid FROM pages"


def t10_log(d: Spark) -> str:
    """Metrics read from a log line; null where it doesn't match."""
    line = "concat('EM: ', cast(c_custkey % 100 AS string), ' F1: ', cast(c_custkey % 90 AS string), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' done' END)"
    rx = r"EM: ([0-9]+) F1: ([0-9]+) done"
    return f"WITH l AS (SELECT c_custkey, {line} AS line FROM customer) SELECT c_custkey, {d.number(d.group('line', rx, 1))} AS em, {d.number(d.group('line', rx, 2))} AS f1 FROM l"


def t15_joined(d: Spark) -> str:
    """Passages of a group as one text, in order."""
    body = "array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '\\n\\n')" if d.name == "spark" else "string_agg(text, chr(10) || chr(10) ORDER BY turn, text)"
    return f"SELECT conv_id, {d.sha(body)} AS sha, cast(count(*) AS bigint) AS n FROM conversations GROUP BY conv_id"


def t18_labels(d: Spark) -> str:
    """Candidates labelled C1 and so on, with their sources."""
    sources = "array_join(sort_array(collect_list(src)), ',')" if d.name == "spark" else "string_agg(src, ',' ORDER BY src)"
    return f"{_with(d, v.candidates(d))}, g AS (SELECT qid, value, min(pos) AS pos, {sources} AS sources FROM candidates WHERE value <> '' GROUP BY qid, value) SELECT qid, concat('C', cast(row_number() OVER (PARTITION BY qid ORDER BY pos) AS string)) AS label, value, sources FROM g"


def t30_shapes(d: Spark) -> str:
    return f"{_with(d, v.pairs(d))} SELECT qid, {d.size(t.tokens(d, 'gold'))} <= 6 AND length(gold) <= 60 AS short, {t.normalized(d, 'gold')} IN ('yes', 'no') AS binary FROM pairs"


def t31_first_fit(d: Spark) -> str:
    """The first answer in order of sources that fits."""
    first = d.at(d.filter(d.array("second_word", "first_word", "last_word", "lang"), "x", "length(x) BETWEEN 3 AND 9"), 1)
    return f"{_with(d, v.candidates(d))} SELECT qid, coalesce({first}, '') AS answer FROM wide"


QUERIES = (k6_probe_states, k9_labels, k10_reviews, k12_variants, k13_sources, d4_surfaces, d9_conformance, d11_targets, d12_classes, e1_slice, e8_priorities, e13_seeded, f2_pairwise, f4_enriched, f11_endpoints, g25_same_ids, g27_missing, g28_cases, j9_graph_answers, j10_clean, j12_population, j13_names, j18_json, l5_directed, l16_gap_place, l19_statistics, l22_upserts, l25_recall, m4_queries, m5_evidence, o2_counts, o6_presence, q5_routes, t5_strict, t7_identifiers, t10_log, t15_joined, t18_labels, t30_shapes, t31_first_fit)
