"""Graph retrieval, noise probes, extraction, failures and artifact verification."""

from __future__ import annotations

from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import views as v
from veritrail.plans.graph import _REGIONS, UNDIRECTED, _distances
from veritrail.plans.texts import _ASKS, _alnum, _bm25, _lowered


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


#: Questions about each region in the words of triples, and all triples as passages; a triple's hash is its number.
_GRAPH_ASKS = "SELECT r_regionkey AS qid, concat('which nation is in region ', lower(r_name)) AS question FROM region"


def _triples(d: Spark) -> str:
    best = "best AS (SELECT qid, pid AS triple, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS nth FROM scores WHERE score > 0)"
    text = "concat(h, ' -- ', r, ' --> ', t) AS triple, concat(replace(h, ':', ' '), ' ', replace(r, '_', ' '), ' ', replace(t, ':', ' ')) AS body"
    if d.name == "spark":
        return f"{v.counted()}, facts AS (SELECT h, r, t, {text} FROM counted), {_bm25_once(d, _GRAPH_ASKS, 'SELECT triple AS pid, body FROM facts', _lowered(d))}, {best}"
    return f"""{v.kg(d)}, facts AS (SELECT h, r, t, {text} FROM (SELECT DISTINCT h, r, t FROM triples) x),
  {_bm25(d, _GRAPH_ASKS, "SELECT triple AS pid, body FROM facts", _lowered(d))}, {best}"""


def _bm25_once(d: Spark, queries: str, corpus: str, words) -> str:
    """For Spark, the scores of _bm25 for few queries over a corpus of distinct pids: no word of a passage moves, but counts of words and those words that queries have."""
    return f"""corpus AS ({corpus}), asks AS ({queries}), worded AS (SELECT pid, w, cast({d.size("w")} AS double) AS dl FROM (SELECT pid, {words("body")} AS w FROM corpus) x),
  totals AS (SELECT cast(count(*) AS double) AS n, sum(dl) / count(*) AS avgdl FROM worded), holders AS (SELECT term, count(*) AS df FROM (SELECT explode(array_distinct(w)) AS term FROM worded) x GROUP BY term),
  raw_idf AS (SELECT term, ln(n - df + 0.5) - ln(df + cast(0.5 AS double)) AS idf FROM holders JOIN totals ON true), mean_idf AS (SELECT avg(idf) AS m FROM raw_idf),
  ask_terms AS (SELECT qid, term, cast(count(*) AS double) AS qtf FROM asks, {d.rows(words("question"), "term")} GROUP BY qid, term), asked AS (SELECT collect_set(term) AS terms FROM ask_terms),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM raw_idf LEFT SEMI JOIN ask_terms USING (term) JOIN mean_idf ON true), weights AS (SELECT qid, a.term, qtf * idf AS weight FROM ask_terms a JOIN idf i ON i.term = a.term),
  doc_terms AS (SELECT pid, dl, term, cast(size(w) - size(array_remove(w, term)) AS double) AS tf FROM (SELECT pid, dl, w, explode(array_intersect(w, terms)) AS term FROM worded JOIN asked ON true) x),
  scores AS (SELECT /*+ BROADCAST(a) */ a.qid, x.pid, round(sum(a.weight * x.tf * 2.5 / (x.tf + 1.5 * (0.25 + 0.75 * x.dl / avgdl))), 4) AS score FROM doc_terms x JOIN weights a ON a.term = x.term JOIN totals ON true GROUP BY a.qid, x.pid)"""


def _top(d: Spark, more: str = "") -> str:
    """The twenty best triples of each question; so few that on Spark they go to where the triples are."""
    return f"top AS (SELECT {'/*+ BROADCAST(best) */ ' if d.name == 'spark' else ''}qid, h, t{more} FROM best JOIN facts ON best.triple = facts.triple WHERE nth <= 20)"


def l7_seeds(d: Spark) -> str:
    """Seed nodes: heads and tails of the twenty triples, of all, that score best for a question."""
    return f"{_with(d, _triples(d))}, {_top(d)} SELECT qid, h AS node FROM top UNION SELECT qid, t FROM top"


def l9_retrieval(d: Spark) -> str:
    """Triples that touch the seeds of a question, by the order of their seeds, then the twenty best by score; the first of each, fifty at most."""
    few = "/*+ BROADCAST(s) */ " if d.name == "spark" else ""
    return f"""{_with(d, _triples(d))}, {_top(d, ", nth")}, seeds AS (SELECT qid, node, min(nth) AS nth FROM (SELECT qid, h AS node, nth FROM top UNION ALL SELECT qid, t, nth FROM top) x GROUP BY qid, node),
  near AS (SELECT qid, triple, min(nth) AS nth FROM (SELECT {few}s.qid, f.triple, s.nth FROM seeds s JOIN facts f ON f.h = s.node UNION ALL SELECT {few}s.qid, f.triple, s.nth FROM seeds s JOIN facts f ON f.t = s.node) x GROUP BY qid, triple),
  listed AS (SELECT qid, triple, 0 AS part, nth FROM near UNION ALL SELECT qid, triple, 1, nth FROM best WHERE nth <= 20), once AS (SELECT *, row_number() OVER (PARTITION BY qid, triple ORDER BY part, nth) AS seen FROM listed),
  k AS (SELECT qid, triple, part, row_number() OVER (PARTITION BY qid ORDER BY part, nth, triple) AS place FROM once WHERE seen = 1) SELECT qid, triple, part = 0 AS by_graph, cast(place AS bigint) AS place FROM k WHERE place <= 50"""


def l21_first_pairs(d: Spark) -> str:
    """The first five pairs of each region that no path of two edges joins, and the triple that would repair each."""
    return f"""{_with(d, v.kg(d), UNDIRECTED)}, {_distances(d, _REGIONS, 2)}, asked AS (SELECT concat('region:', r_name) AS entity, concat('customer:', cast(c_custkey AS string)) AS candidate FROM customer JOIN region ON r_regionkey = c_custkey % 5),
  gaps AS (SELECT a.entity, a.candidate, row_number() OVER (PARTITION BY a.entity ORDER BY a.candidate) AS k FROM asked a LEFT JOIN reached r ON r.origin = a.entity AND r.node = a.candidate WHERE r.hops IS NULL)
  SELECT entity, candidate, cast(k AS bigint) AS k, concat(candidate, ' -- related_to --> ', entity) AS repair FROM gaps WHERE k <= 5"""


def t36_noise(d: Spark) -> str:
    """The five best of all distinct passages for each question, those of no score included, which come in their order."""
    return f"""{_with(d, _bm25(d, _ASKS, "SELECT min(item_id) AS pid, text AS body FROM benchmark WHERE text IS NOT NULL GROUP BY text", _alnum(d)))}, first AS (SELECT pid FROM corpus ORDER BY pid LIMIT 10),
  rest AS (SELECT a.qid, f.pid FROM asks a JOIN first f ON true LEFT JOIN scores s ON s.qid = a.qid AND s.pid = f.pid AND s.score > 0 WHERE s.pid IS NULL),
  listed AS (SELECT qid, pid, score FROM scores WHERE score > 0 UNION ALL SELECT qid, pid, cast(0 AS double) FROM rest), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM listed) SELECT qid, pid, score, cast(r AS bigint) AS r FROM k WHERE r <= 5"""


#: What the deterministic extractor reads as a triple: a name, a lower-case relation of one or two words, and a name.
TRIPLE = r"([A-ZÀ-Þ][A-Za-zÀ-ÿ]+) ([a-zà-ÿ]+(?: [a-zà-ÿ]+)?) ([A-ZÀ-Þ][A-Za-zÀ-ÿ]+)"


def _extracted(d: Spark) -> str:
    """Triples of whole documents, in lower-case relations; a name on both sides is none."""
    part = lambda i: d.all("text", TRIPLE, i)
    return f"""found AS (SELECT doc_id, {part(1)} AS hs, {part(2)} AS rs, {part(3)} AS ts FROM documents WHERE text IS NOT NULL), each AS (SELECT doc_id, hs, rs, ts, i FROM found, {d.rows(d.span("1", d.size("hs")), "i")}),
  extracted AS (SELECT doc_id, {d.at("hs", "cast(i AS int)")} AS h, lower({d.at("rs", "cast(i AS int)")}) AS r, {d.at("ts", "cast(i AS int)")} AS t FROM each)"""


def l1_extraction(d: Spark) -> str:
    """Triples read from whole texts by a fixed pattern."""
    return f"{_with(d, _extracted(d))} SELECT doc_id, h, r, t, cast(count(*) AS bigint) AS n FROM extracted WHERE h <> t GROUP BY doc_id, h, r, t"


def l20_enhanced(d: Spark) -> str:
    """A graph of the even documents enhanced by triples about the entities it lacks, which the labelled ones name: what is added, by source."""
    return f"""{_with(d, _extracted(d))}, base AS (SELECT DISTINCT h, r, t FROM extracted WHERE h <> t AND doc_id % 2 = 0), nodes AS (SELECT h AS node FROM base UNION SELECT t FROM base),
  asked AS (SELECT DISTINCT h AS entity FROM extracted JOIN labels ON labels.doc_id = extracted.doc_id), missing AS (SELECT entity FROM asked WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node = entity)),
  added AS (SELECT DISTINCT e.doc_id, e.h, e.r, e.t FROM extracted e JOIN missing m ON m.entity = e.h WHERE e.h <> e.t) SELECT source, cast(count(*) AS bigint) AS added, cast(count(DISTINCT h) AS bigint) AS entities FROM added a JOIN documents d ON d.doc_id = a.doc_id GROUP BY source"""


def b11_failures(d: Spark) -> str:
    """A row for each case that failed: the stage in which it did, and its message."""
    return f"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
  k AS (SELECT concat(cast(q.conv_id AS string), '-', cast(q.turn AS string)) AS case_id, CASE WHEN {t.tidy(d, "coalesce(q.text, '')")} = '' THEN 'input' WHEN answer IS NULL THEN 'generate' WHEN {t.bad_pipeline(d, "answer")} THEN 'parse' WHEN {t.n_words(d, "answer")} > 200 THEN 'limit' END AS stage, answer FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn)
  SELECT case_id, stage, CASE stage WHEN 'input' THEN 'empty question' WHEN 'generate' THEN 'no answer' WHEN 'parse' THEN concat('no answer in: ', substring(answer, 1, 40)) ELSE concat('words: ', cast({t.n_words(d, "answer")} AS string)) END AS message FROM k WHERE stage IS NOT NULL"""


def o5_verified(d: Spark) -> str:
    """Six verifications: what was claimed (counts of a table) against what the rows give (of the audit), by check and key."""
    rows = lambda check, key, claimed, found: f"SELECT '{check}' AS check_, cast({key} AS string) AS key_, cast({claimed} AS double) AS claimed, cast({found} AS double) AS found"
    ones = lambda x: f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)"
    counted = "(SELECT d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) y"
    by = lambda group, claimed: f"(SELECT {group} AS k, {claimed} AS claimed FROM {counted} GROUP BY {group}) z"
    states = "CASE WHEN n_chars % 3 <> 0 THEN 'complete' ELSE 'incomplete' END"
    return f"""{_with(d, v.audit(d))}, checks AS ({" UNION ALL ".join((
        rows("manifest", "k", "claimed", "found") + f" FROM (SELECT dataset AS g, count(*) AS found FROM audit GROUP BY dataset) x LEFT JOIN {by('source', 'count(*)')} ON k = g",
        rows("visibility", "k", "claimed", "found") + f" FROM (SELECT type AS g, {ones('selected')} AS found FROM audit GROUP BY type) x LEFT JOIN {by('lang', ones('toxic = 0'))} ON k = g",
        rows("ablation", "k", "claimed", "found") + f" FROM (SELECT dataset AS g, round(avg(em), 4) AS found FROM audit GROUP BY dataset) x LEFT JOIN {by('source', 'round(avg(cast(quality AS double)), 4)')} ON k = g",
        rows("selection", "k", "claimed", "found") + f" FROM (SELECT dataset AS g, {ones('selected AND NOT complete')} AS found FROM audit GROUP BY dataset) x LEFT JOIN {by('source', ones('toxic = 0 AND n_chars % 3 = 0'))} ON k = g",
        rows("routing", "k", "claimed", "found") + f" FROM (SELECT CASE WHEN complete THEN 'complete' ELSE 'incomplete' END AS g, count(*) AS found FROM audit GROUP BY 1) x LEFT JOIN {by(states, 'count(*)')} ON k = g",
        rows("residual", "k", "claimed", "found") + f" FROM (SELECT dataset AS g, {ones('residual AND unrepaired')} AS found FROM audit GROUP BY dataset) x LEFT JOIN {by('source', ones('n_chars % 3 = 0 AND n_chars % 4 <> 0 AND n_chars % 5 >= 3'))} ON k = g",
    ))}) SELECT check_, key_, claimed, found, coalesce(abs(claimed - found) < 0.00005, false) AS holds FROM checks"""


def m9_short(d: Spark) -> str:
    """Answers of at most eight words as they are, else the sentence with most words of the question, of the first thousand characters."""
    return f"""WITH q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
  k AS (SELECT concat(cast(q.conv_id AS string), '-', cast(q.turn AS string)) AS qid, question, coalesce(answer, '') AS answer FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn), {best_sentence(d, "k", "qid", "question", "substring(answer, 1, 1000)")}
  SELECT k.qid, CASE WHEN {t.n_words(d, "k.answer")} <= 8 THEN {t.tidy(d, "k.answer")} ELSE coalesce(b.sentence, 'unknown') END AS short FROM k LEFT JOIN best_sentences b ON b.id = k.qid"""


def best_sentence(d: Spark, table: str, key: str, question: str, evidence: str) -> str:
    """best_sentences (id, sentence, shared, asked): of each row the sentence that shares most distinct words with the question, the earliest of equals, if any does."""
    mark = "\x01"
    parts = d.split(d.rep(f"coalesce({evidence}, '')", r"([.!?])\s+", "\\1" + mark), mark)
    names = lambda x: d.distinct(d.all(f"lower(coalesce({x}, ''))", r"[\p{L}\p{M}\p{N}_]+"))
    return f"""parted AS (SELECT {key} AS id, {names(question)} AS asked, {parts} AS sentences FROM {table}), sentences AS (SELECT id, asked, sentences, i FROM parted, {d.rows(d.span("1", d.size("sentences")), "i")}),
  met AS (SELECT id, i, trim({d.at("sentences", "cast(i AS int)")}) AS sentence, {d.size("asked")} AS asked, {d.size(d.common(names(d.at("sentences", "cast(i AS int)")), "asked"))} AS shared FROM sentences),
  best_sentences AS (SELECT id, sentence, shared, asked FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, i) AS r FROM met WHERE shared > 0) x WHERE r = 1)"""


def q1_reader(d: Spark) -> str:
    """What the extractive reader answers to user turns from the assistant turn that follows, and how sure it is (SQL of the same rule)."""
    return f"""WITH q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS evidence FROM conversations WHERE role = 'assistant'),
  k AS (SELECT q.conv_id * 1000 + q.turn AS id, q.conv_id, q.turn, question, evidence FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn), {best_sentence(d, "k", "id", "question", "evidence")}
  SELECT conv_id, turn, coalesce(sentence, 'unknown') AS answer, coalesce(cast(shared AS double) / greatest(1, asked), 0) AS confidence FROM k LEFT JOIN best_sentences b ON b.id = k.id"""


QUERIES = (l7_seeds, l9_retrieval, t36_noise, l1_extraction, l20_enhanced, b11_failures, o5_verified, m9_short)
#: Distances first, which Spark finds in rounds.
REACHED = {l21_first_pairs: 2}
