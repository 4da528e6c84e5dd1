"""Plans for context shapes, gates, selectors and artifact bookkeeping that the other modules leave."""

from __future__ import annotations

from veritrail.functions import classify as c
from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import audit as a
from veritrail.plans import views as v


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


def _flag(x: str) -> str:
    return f"coalesce({x}, false)"


def c1_ids(d: Spark) -> str:
    """Ids by presence (id first) and by truth (_id first), with the position as the last resort."""
    return """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN cast(user_id AS string) WHEN event_id % 3 = 1 THEN '' END AS id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS _id FROM events)
  SELECT event_id, coalesce(id, _id, cast(event_id AS string)) AS by_presence, coalesce(nullif(_id, ''), nullif(id, ''), cast(event_id AS string)) AS by_truth FROM r"""


def c4_contexts(d: Spark) -> str:
    """Three physical shapes of a context told apart and brought to title and text."""
    shape = "CASE WHEN doc_id % 3 = 0 THEN concat('{\"', source, '\": [\"', lang, '\"]}') WHEN doc_id % 3 = 1 THEN concat('[[\"', source, '\", [\"', lang, '\"]]]') ELSE concat('[\"', lang, '\"]') END"
    return f"""WITH r AS (SELECT doc_id, {shape} AS raw FROM documents)
  SELECT doc_id, CASE WHEN {d.starts("raw", "'{'")} THEN 'map' WHEN {d.starts("raw", "'[['")} THEN 'pairs' ELSE 'texts' END AS shape, CASE WHEN {d.starts("raw", "'[\"'")} THEN 'document' ELSE {d.group("raw", '"([^"]*)"', 1)} END AS title,
  {d.at(d.all("raw", '"([^"]*)"', 1), -1)} AS body FROM r"""


def c6_compositions(d: Spark) -> str:
    """Title and non-blank sentences as one text, or the title alone."""
    body = "trim(CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END)"
    return f"SELECT doc_id, CASE WHEN {body} = '' THEN source ELSE concat(source, ': ', {body}) END AS passage FROM documents"


def c13_histories(d: Spark) -> str:
    """Steps of a trace that repair or fall back, in order, with their number."""
    listed = "transform(array_sort(collect_list(struct(event_id, event_type))), x -> x.event_type)" if d.name == "spark" else "list(event_type ORDER BY event_id)"
    return f"""WITH h AS (SELECT user_id, {listed} AS steps FROM events GROUP BY user_id), k AS (SELECT user_id, steps, {d.filter("steps", "x", "x IN ('click', 'purchase')")} AS repairs FROM h)
  SELECT user_id, {d.size("steps")} AS n_steps, {d.size("repairs")} AS n_repairs, {d.joined(d.slice("repairs", "1", "5"), " | ")} AS first_repairs, coalesce({d.at("repairs", -1)}, '') AS last_repair, coalesce({d.at("repairs", 1)}, '') AS first_repair FROM k"""


def c17_chunks(d: Spark) -> str:
    """Chunks of a tool result at blank lines, white space once, 60 characters."""
    parts = d.filter(d.transform(d.split("text", r"\n"), "x", f"substring({t.tidy(d, 'x')}, 1, 60)"), "x", "x <> ''")
    return f"WITH s AS (SELECT conv_id, turn, {parts} AS parts FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, cast(part_at AS bigint) AS place, part FROM s, {d.placed('parts', 'part')}"


def d10_mismatches(d: Spark) -> str:
    """Location answers that look like none while the current one does, and film answers whose quote names no film."""
    places = ("city", "county", "state", "province", "country", "region")
    looks = lambda x: f"(contains({x}, ',') OR {t.has_any(d, f'lower({x})', places)})"
    asks = t.has_any(d, "lower(question)", ("where", "what city", "what country", "what region", "headquartered", "located"))
    return f"""WITH k AS (SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'Where is ' WHEN 1 THEN 'Which film is ' ELSE 'What is ' END, p_name, '?') AS question, concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' County' ELSE '' END) AS current, p_type AS proposed, concat(p_type, CASE WHEN p_partkey % 5 = 0 THEN ' film' ELSE '' END) AS quote FROM part)
  SELECT p_partkey, {asks} AND NOT {t.bad_evaluation(d, "current")} AND NOT {looks("proposed")} AND NOT {t.has_any(d, "lower(proposed)", ("united", "south", "north", "east", "west"))} AND {looks("current")} AND {d.size(t.tokens(d, "proposed"))} <= 4 AS location_mismatch,
  contains(lower(question), 'which film') AND contains({t.normalized(d, "quote")}, {t.normalized(d, "proposed")}) AND NOT contains(lower(quote), 'film') AS film_mismatch FROM k"""


def g4_files(d: Spark) -> str:
    """Mean scores of each source that has them."""
    return f"{_with(d, v.audit(d))} SELECT concat(dataset, '_', type) AS name, {a.METRICS} FROM audit GROUP BY dataset, type"


def h5_steps(d: Spark) -> str:
    return "SELECT conv_id, turn, role, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS bigint) AS step FROM conversations"


def j15_canonical(d: Spark) -> str:
    """Answers made canonical by their type: awards, persons, or as they are."""
    n = t.n_words(d, "x")
    award, person = d.rep("x", r"\s+[0-9]{4}$"), f"CASE WHEN {n} >= 3 THEN {d.rep('x', '^(Colonel|Count|Air Commodore|Maharaja|Grand Prince) ')} ELSE x END"
    return f"WITH k AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'award' WHEN 1 THEN 'person' ELSE 'entity' END AS kind, {t.edged(d, 'concat(CASE WHEN p_partkey % 2 = 0 THEN ' + d.lit('Count ') + ' ELSE ' + d.lit('') + ' END, p_name, ' + d.lit(' 1999.') + ')')} AS x FROM part) SELECT p_partkey, kind, CASE kind WHEN 'award' THEN {award} WHEN 'person' THEN {person} ELSE x END AS answer FROM k"


def j21_expansions(d: Spark) -> str:
    """Canonical expansion: a strict superset of tokens that holds the text, by two words at most, with the same last token."""
    p, g = "p", "g"
    return f"""{_with(d, v.pairs(d))}, k AS (SELECT qid, pred, gold, {t.tokens(d, "pred")} AS p, {t.tokens(d, "gold")} AS g FROM pairs)
  SELECT qid, {d.size(p)} > 0 AND {t.subset(d, p, g)} AND NOT {t.subset(d, g, p)} AND {d.size(g)} <= {d.size(p)} + 2 AND contains(lower(gold), lower(pred)) AS expansion,
  {_flag(f"{d.at(p, -1)} = {d.at(g, -1)}")} AS same_last FROM k"""


def j23_spans(d: Spark) -> str:
    """Spans of a text that fit a type: years, numbers and capitalized runs, first of each."""
    return f"SELECT conv_id, turn, {d.group('text', '(?:^|[^0-9])((?:1[0-9]{3}|20[0-9]{2}))(?:$|[^0-9])', 1)} AS year_, {d.group('text', '([0-9][0-9,.]*)', 1)} AS number_, {d.group('text', '([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)} AS name FROM conversations"


def k2_variants(d: Spark) -> str:
    """Question shapes: yes or no, both, comparison, disjunction of facts."""
    q = "lower(trim(question))"
    return f"""{_with(d, v.questions(d))} SELECT qid, {t.starts_any(d, q, t.YESNO_STARTS)} AS yesno, contains({q}, ' both ') OR {t.starts_any(d, q, ("are both", "were both"))} AS both_, {t.has_any(d, q, c.COMPARISON_WORDS)} AS comparison,
  contains({q}, ' or ') AND {d.rlike(q, '[0-9]')} AS disjunctive_fact FROM questions"""


def n9_meta_rules(d: Spark) -> str:
    """Ordered rules over the chosen source, its confidence and the question."""
    q = "lower(question)"
    return f"""{_with(d, v.questions(d))}, k AS (SELECT qid, question, CASE conv_id % 5 WHEN 0 THEN 'contextual_prior' WHEN 1 THEN 'reader_consensus' WHEN 2 THEN 'graph_consensus' ELSE '' END AS choice, CASE conv_id % 3 WHEN 0 THEN 'medium' ELSE 'high' END AS conf, CASE conv_id % 4 WHEN 0 THEN 'guarded' WHEN 1 THEN 'prior' ELSE 'reader' END AS src FROM questions)
  SELECT qid, CASE WHEN choice = 'contextual_prior' AND NOT {t.has_any(d, q, ("first", "older", "recent"))} THEN 'contextual_prior_safe' WHEN choice = 'reader_consensus' THEN 'reader_consensus' WHEN choice = 'graph_consensus' AND {t.starts_any(d, f"trim({q})", ("are both", "were both"))} THEN 'graph_consensus_are_both'
  WHEN conf = 'medium' AND src = 'guarded' THEN 'medium_guarded_or_judge' WHEN src = 'prior' AND NOT contains({q}, 'released first') THEN 'prior_not_released_first' ELSE 'baseline' END AS rule FROM k"""


def o1_fingerprints(d: Spark) -> str:
    """Size and content hash of each stored page."""
    return f"SELECT page_id, url, cast(length(html) AS bigint) AS size_, {d.sha('html')} AS sha256 FROM pages"


def t2_ranges(d: Spark) -> str:
    """Starts and lengths of contiguous shards."""
    return "WITH n AS (SELECT count(*) AS total FROM conversations), s AS (SELECT r_regionkey AS shard FROM region) SELECT cast(shard AS bigint) AS shard, cast(floor(cast(shard * total AS double) / 5) AS bigint) AS start_, cast(floor(cast((shard + 1) * total AS double) / 5) - floor(cast(shard * total AS double) / 5) AS bigint) AS n FROM s JOIN n ON true"


def t13_punctuated(d: Spark) -> str:
    """Sentences of a passage body, each under its title."""
    sentences = d.filter(d.transform(d.all("text", r"[^.!?]+[.!?]*"), "x", t.tidy(d, "x")), "x", "x <> ''")
    return f"WITH s AS (SELECT item_id, {sentences} AS sentences FROM benchmark) SELECT item_id, cast(sentence_at AS bigint) AS place, concat('item_', cast(item_id AS string), ': ', sentence) AS sentence FROM s, {d.placed('sentences', 'sentence')}"


def t16_subset(d: Spark) -> str:
    """Rows of a list of ids that aren't done yet."""
    return "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)"


def t19_indexes(d: Spark) -> str:
    """Valid distinct indexes of a list from 1 to 9, four at most, in order of first occurrence."""
    found = d.sorted(d.distinct(d.transform(d.filter(d.all("props", "[0-9]"), "x", "x <> '0'"), "x", "cast(x AS bigint)")))
    return f"SELECT event_id, {d.joined(d.transform(d.slice(found, '1', '4'), 'x', 'cast(x AS string)'), ',')} AS indexes FROM events"


def t20_picked(d: Spark) -> str:
    """The passage that an index names, else the first."""
    return f"SELECT doc_id, coalesce({d.at(d.split('text', '[.]'), 'cast(1 + doc_id % 7 AS int)')}, {d.at(d.split('text', '[.]'), 1)}) AS passage FROM documents"


def t21_vectors(d: Spark) -> str:
    return f"{_with(d, v.usage(d))} SELECT mode, round(sum(tokens), 4) AS tokens, round(sum(wall_time), 4) AS wall_time, cast(count(*) AS bigint) AS calls FROM usage GROUP BY mode"


def t22_tagged(d: Spark) -> str:
    """Several sources as one table with their names."""
    return "SELECT 'benchmark' AS source, item_id AS id, cast(length(text) AS bigint) AS n FROM benchmark UNION ALL SELECT 'documents', doc_id, cast(length(text) AS bigint) FROM documents UNION ALL SELECT 'pages', page_id, cast(length(html) AS bigint) FROM pages"


def t23_kg_fields(d: Spark) -> str:
    """Candidates of fields that name the graph, and of families in priority order, distinct by form."""
    return f"{_with(d, v.candidates(d))}, k AS (SELECT qid, {t.normalized(d, 'value')} AS norm, min(pos) AS pos FROM candidates WHERE contains(field, 'kg') OR contains(field, 'context') GROUP BY qid, {t.normalized(d, 'value')}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM k WHERE norm <> '') SELECT qid, norm, cast(r AS bigint) AS r FROM r WHERE r <= 8"


def t27_sources(d: Spark) -> str:
    """Up to five source:field=answer entries."""
    listed = "array_join(slice(array_sort(collect_set(concat(src, ':', field, '=', value))), 1, 5), '; ')" if d.name == "spark" else "array_to_string(list_slice(list_sort(list(DISTINCT concat(src, ':', field, '=', value))), 1, 5), '; ')"
    return f"{_with(d, v.candidates(d))} SELECT qid, {listed} AS sources FROM candidates WHERE value <> '' GROUP BY qid"


def t28_members(d: Spark) -> str:
    """Whether an answer is among the candidates, by normalized form."""
    norms = [t.normalized(d, x) for x in ("first_word", "second_word", "last_word")]
    return f"{_with(d, v.candidates(d))} SELECT qid, {t.normalized(d, 'lang')} IN ({', '.join(norms)}) AS lang_is_candidate, {norms[0]} IN ({norms[1]}, {norms[2]}) AS first_is_candidate FROM wide"


def t32_quotes(d: Spark) -> str:
    """The first sentence that holds an answer, else empty."""
    if d.name == "spark":
        # An answer with a stop is in no sentence; another is first met in the sentence around its first place.
        ninth = d.group("text", r"^[ \t\n\r\f\x0b]*+(?:[^ \t\n\r\f\x0b]++[ \t\n\r\f\x0b]++){8}([^ \t\n\r\f\x0b]++)")
        around = "concat(substring_index(substring(text, 1, at - 1), '.', -1), substring_index(substring(text, at), '.', 1))"
        return f"WITH s AS (SELECT doc_id, text, {ninth} AS answer FROM documents), p AS (SELECT doc_id, text, CASE WHEN contains(answer, '.') THEN 0 ELSE instr(text, answer) END AS at FROM s) SELECT doc_id, coalesce(CASE WHEN at = 0 THEN '' ELSE {around} END, '') AS quote FROM p"
    return f"WITH s AS (SELECT doc_id, {d.at(t.words(d, 'text'), 9)} AS answer, {d.split('text', '[.]')} AS quotes FROM documents) SELECT doc_id, coalesce({d.at(d.filter('quotes', 'x', 'contains(x, coalesce(answer, ' + d.lit('') + '))'), 1)}, '') AS quote FROM s"


def t38_composite(d: Spark) -> str:
    """Rows by a composite key, the last one staying."""
    return "WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) SELECT l_orderkey, l_partkey, l_quantity FROM r WHERE r = 1"


QUERIES = (c1_ids, c4_contexts, c6_compositions, c13_histories, c17_chunks, d10_mismatches, g4_files, h5_steps, j15_canonical, j21_expansions, j23_spans, k2_variants, n9_meta_rules, o1_fingerprints, t2_ranges, t13_punctuated, t16_subset, t19_indexes, t20_picked, t21_vectors, t22_tagged, t23_kg_fields, t27_sources, t28_members, t32_quotes, t38_composite)
