"""Selectors that choose among competing answers: scores of candidate groups, conflicts, choices and overrides.

Each rule is a function of column names, so that tests can give it values; the plans put
them over user turns, whose following assistant turn gives the competing answers.
"""

from __future__ import annotations

from veritrail.functions import text as t
from veritrail.functions.dialect import Spark

# Markers, kinds and weights that decide results.
BAD_SURFACES = (
    "unknown", "insufficient", "not enough", "provided context", "context passage", "does not mention", "do not mention", "cannot determine", "none of",
    "no triple", "not specified", "instructions", "using only", "but perhaps", "perhaps the answer", "the question is", "graph doesn",
)
BAD_FALLBACKS = ("insufficient", "none", "cannot", "not enough", "no information", "nothing", "neither", "no triple", "not specified", "unknown")
YESNO = ("are ", "were ", "do ", "did ", "does ", "is ", "was ", "has ", "have ", "had ", "can ")
COMPARISON = ("born first", "born later", "older", "younger", "newer", "released first", "came out first", "appeared first", "closer", "nearer", "more ", "larger", "bigger", "which one", "between the two")
DIRECTIONS = ("further north", "further south", "further east", "further west", "farther north", "farther south", "farther east", "farther west")
NUMBER_DATE = ("what year", "how many", "when was", "when did", "period", "date", "population", "number")
LOCATION = ("what city", "what country", "what region", "located", "headquartered")
PERSON = ("who", "which author", "which composer", "which actress", "which actor", "which musician", "which player", "which american musician", "which american actress", "which american businessman", "the player who")
SOURCE_KINDS = (("candidate_choice", "choice"), ("contextual_prior_v2", "prior"), ("guarded_judge", "guarded"), ("evidence_reader_support_first", "support_first"), ("evidence_reader", "reader"), ("final_verifier", "verifier"), ("meta_selector", "meta"))
KIND_BONUS = (("choice", 2.0), ("prior", 1.5), ("reader", 1.0), ("support_first", 1.0), ("verifier", 0.8), ("guarded", 0.7), ("meta", 0.3))
FIELD_WEIGHTS = ((("contextual_prior_v2",), 6.0), (("candidate_context", "context_answer"), 5.0), (("candidate_choice_answer",), 4.0), (("source_calibrated_answer",), 4.0), (("reader_support",), 3.0), (("reader_v1",), 2.5), (("judge_v2",), 2.0))
LONG_MARKS = (" because ", "however", "instructions", "triple", ";")
JOINTS = ("to", "of", "for", "in", "from", "and", "or", "with", "at", "by")
NO_NAMES = ("tribute ", "the ", "a ", "an ", "both ", "film ", "american ", "professional ")
PROCEDURAL = ("instructions require", "using *only*", "given triples", "triples", "absent")
ABSENCE = ("no evidence", "not enough evidence", "none of the evidence", "does not mention", "do not mention", "doesn't mention", "no passage mentions", "no passage states", "absence of", "ambiguous", "cannot determine", "not provided", "not specified")


def question_kind(d: Spark, q: str, conflict: bool = False) -> str:
    """The class of a question by which a selector scores answers; conflict: comparisons go before yes and no, and there are more of them."""
    low = f"trim(lower(coalesce({q}, '')))"
    first = [f"WHEN {t.starts_any(d, low, YESNO)} THEN 'yesno'", f"WHEN {t.has_any(d, low, COMPARISON + (DIRECTIONS if conflict else ()))} THEN 'comparison'"]
    return (
        f"CASE {' '.join(first[::-1] if conflict else first)} WHEN {t.has_any(d, low, NUMBER_DATE)} THEN 'number_date' "
        f"WHEN {d.starts(low, d.lit('where'))} OR {t.has_any(d, low, LOCATION)} THEN 'location' WHEN {d.starts(low, d.lit('who'))} OR contains(substring({low}, 1, 160), ' who ') THEN 'person' "
        f"WHEN contains(concat(' ', {low}, ' '), ' both ') OR contains({low}, ' in common') OR contains({low}, 'same ') THEN 'common' ELSE 'other' END"
    )


def bad_surface(d: Spark, x: str, tokens: int = 12, characters: int = 180) -> str:
    """Text that can't be an answer: empty, over so many tokens or characters, or of a form."""
    low = f"trim(lower(coalesce({x}, '')))"
    return f"({t.normalized(d, x)} = '' OR {d.size(t.tokens(d, x))} > {tokens} OR length({low}) > {characters} OR {t.starts_any(d, low, ('{', '- '))} OR {t.has_any(d, low, BAD_SURFACES)})"


def bad_fallback(d: Spark, x: str) -> str:
    low = f"trim(lower(coalesce({x}, '')))"
    return f"({low} = '' OR {t.has_any(d, low, BAD_FALLBACKS)})"


def minor_alias(d: Spark, a: str, b: str, same: str = "true") -> str:
    """Close surfaces: at most four tokens apart, one within the other as text or as tokens; same: the value for equal or empty ones."""
    an, bn, at, bt = t.normalized(d, a), t.normalized(d, b), t.tokens(d, a), t.tokens(d, b)
    inside = f"contains({an}, {bn}) OR contains({bn}, {an}) OR {t.subset(d, at, bt)} OR {t.subset(d, bt, at)}"
    return f"CASE WHEN {an} = '' OR {bn} = '' OR {an} = {bn} THEN {same} ELSE abs({d.size(at)} - {d.size(bt)}) <= 4 AND ({inside}) END"


def source_kind(d: Spark, source: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({source}, '{m}') THEN '{k}'" for m, k in SOURCE_KINDS) + " ELSE 'other' END"


def field_weight(d: Spark, source: str, field: str, conflict: bool = False) -> str:
    """Weight of a field with its source's bonus; conflict: with the weights of graph fields and plain answers."""
    low = f"lower({field})"
    plain = f"WHEN {t.has_any(d, low, ('candidate_kg', '|kg'))} OR {low} = 'kg' THEN cast(1.2 AS double) WHEN {t.one_of(d, low, ('answer', 'prediction', 'baseline_answer'))} THEN cast(0.8 AS double)" if conflict else ""
    weights = " ".join(f"WHEN {t.has_any(d, low, marks)} THEN cast({w} AS double)" for marks, w in FIELD_WEIGHTS)
    kinds = " ".join(f"WHEN '{k}' THEN cast({b} AS double)" for k, b in KIND_BONUS)
    return f"((CASE {weights} {plain} ELSE cast(1 AS double) END) + CASE {source_kind(d, source)} {kinds} ELSE cast(0 AS double) END)"


def group_score(d: Spark, answer: str, who: str, conflict: bool = False) -> str:
    """Score of a group of equal answers by w (sum of weights), n, kinds and the flags of its fields and sources.

    Columns of the answer begin with who: norm (normalized), size (tokens) and bad. conflict: as conflicts are ranked, without a prior's bonus and by other lengths.
    """
    one = lambda when, x: f"CASE WHEN {when} THEN cast({x} AS double) ELSE cast(0 AS double) END"
    yes, size = f"{who}_norm IN ('yes', 'no')", f"{who}_size"
    lengths = (one(f"kind IN ('number_date', 'comparison') AND {size} <= 5", 1),) if conflict else (
        one("prior = 1", 1), one(f"kind = 'number_date' AND {size} <= 4", 1), one(f"kind = 'comparison' AND {size} <= 6", 1), one(f"kind IN ('person', 'location') AND {size} <= 6", 0.5), one(f"{size} > 8", -2),
    )
    total = " + ".join((
        "w", "least(n, 10) * cast(0.8 AS double)", "kinds * cast(1.5 AS double)", one("prior_field = 1", 3), one("context_field = 1", 2), one("choice = 1", 2),
        f"CASE WHEN kind = 'yesno' THEN cast(4 AS double) WHEN {yes} THEN cast(-5 AS double) ELSE cast(0 AS double) END", one(f"kind = 'number_date' AND {d.rlike(answer, '[0-9]')}", 2), *lengths,
    ))
    return f"CASE WHEN {who}_bad OR (kind = 'yesno' AND NOT {yes}) THEN cast(-999 AS double) ELSE round({total}, 4) END"


_PREFIXES = ("Are both ", "Who is ", "What year ", "Where ", "Which is older ", "What genre ", "Do ", "What was in common ", "")


def turns(d: Spark) -> str:
    """User turns and what the assistant's whole answer gives: its first, second, third and last words, and all of them."""
    head = "CASE conv_id % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + " END"
    word = lambda i: f"coalesce({d.at('w', i)}, '')"
    return f"""
asked AS (SELECT conv_id, turn, concat(cast(conv_id AS string), '-', cast(turn AS string)) AS qid, concat({head}, text) AS question FROM conversations WHERE role = 'user'),
told AS (SELECT conv_id, turn - 1 AS turn, {t.words(d, "text")} AS w FROM conversations WHERE role = 'assistant'),
turns AS (SELECT a.qid, a.conv_id, a.turn, question, {word(1)} AS first, {word(2)} AS second, {word(3)} AS third, {word(-1)} AS last, concat({word(1)}, ' ', {word(2)}) AS two, concat({word(2)}, ' ', {word(3)}) AS next,
  CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN 'Yes' WHEN (a.conv_id + a.turn) % 3 = 1 THEN 'no.' ELSE {word(1)} END AS verdict FROM asked a LEFT JOIN told b ON a.conv_id = b.conv_id AND a.turn = b.turn)"""


_OCCURRENCES = (
    ("run_candidate_choice", "candidate_choice_answer", "second"), ("run_contextual_prior_v2", "contextual_prior_v2", "next"), ("run_evidence_reader", "candidate_context", "second"), ("run_evidence_reader_support_first", "candidate_reader_support", "first"),
    ("run_final_verifier", "candidate_context", "next"), ("run_guarded_judge", "candidate_judge_v2", "verdict"), ("run_meta_selector", "context_answer", "verdict"), ("run_other", "candidate_kg", "third"),
)


def _groups(d: Spark, conflict: bool = False) -> str:
    """Candidate groups of each turn, its current answer (the first word) and what scores need."""
    limits = (14, 220) if conflict else (12, 180)
    listed = d.records(("pos", "source", "field", "value"), [(str(i), f"'{s}'", f"'{f}'", x) for i, (s, f, x) in enumerate(_OCCURRENCES)])
    rows = f"SELECT qid, pos, source, field, value FROM turns, {listed}"
    first = "min_by(value, pos)" if d.name == "spark" else "arg_min(value, pos)"
    tokens = d.filter(d.split("norm", " "), "w", "w <> ''")
    flag = lambda when: f"max(CASE WHEN {when} THEN 1 ELSE 0 END)"
    return f"""{turns(d)}, occurrences AS ({rows}), kept AS (SELECT *, {t.normalized(d, "value")} AS norm, {source_kind(d, "source")} AS kind, {field_weight(d, "source", "field", conflict)} AS weight FROM occurrences WHERE NOT {bad_surface(d, "value", *limits)}),
g AS (SELECT qid, norm, {first} AS candidate, min(pos) AS pos, cast(count(*) AS bigint) AS n, sum(weight) AS w, count(DISTINCT kind) AS kinds, count(DISTINCT source) AS sources, {flag("contains(field, 'contextual_prior_v2')")} AS prior_field,
  {flag("contains(field, 'candidate_context') OR contains(field, 'context_answer')")} AS context_field, {flag("kind = 'choice'")} AS choice, {flag("kind = 'prior'")} AS prior FROM kept GROUP BY qid, norm),
current AS (SELECT qid, first AS current, {t.normalized(d, "first")} AS cur_norm, {t.tokens(d, "first")} AS cur_tokens, {bad_surface(d, "first", *limits)} AS cur_bad, {question_kind(d, "question", conflict)} AS kind FROM turns),
scored AS (SELECT g.*, norm AS cand_norm, {tokens} AS cand_tokens, {d.size(tokens)} AS cand_size, false AS cand_bad, current, cur_norm, cur_tokens, {d.size("cur_tokens")} AS cur_size, cur_bad, kind FROM g JOIN current c ON g.qid = c.qid)"""


def _alias(d: Spark) -> str:
    """minor_alias() of the current answer and a candidate that is another."""
    inside = f"contains(cur_norm, cand_norm) OR contains(cand_norm, cur_norm) OR {t.subset(d, 'cur_tokens', 'cand_tokens')} OR {t.subset(d, 'cand_tokens', 'cur_tokens')}"
    return f"(cur_norm = '' OR (abs(cur_size - cand_size) <= 4 AND ({inside})))"


def n6_selector(d: Spark, min_score: float = 12.0, min_margin: float = 1.0, min_occurrences: int = 2) -> str:
    """A candidate replaces the current answer by score, by its margin over the current one's score and ten, by occurrences, a field of the prior or context family, and if it is no mere alias."""
    taken = f"c.score >= {min_score} AND c.score - (coalesce(k.score, 0) + 10) >= {min_margin}"
    return f"""WITH {_groups(d)}, cur AS (SELECT qid, {group_score(d, "current", "cur")} AS score FROM scored WHERE norm = cur_norm),
  alt AS (SELECT qid, candidate, kind, pos, n, {group_score(d, "candidate", "cand")} AS score FROM scored WHERE norm <> cur_norm AND n >= {min_occurrences} AND (prior_field = 1 OR context_field = 1) AND NOT {_alias(d)}),
  best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS r FROM alt)
  SELECT q.qid, CASE WHEN {taken} THEN c.candidate ELSE q.first END AS answer, CASE WHEN {taken} THEN concat('conflict_', c.kind) ELSE 'current' END AS rule, coalesce(c.score, 0) AS candidate_score, round(coalesce(k.score, 0) + 10, 4) AS current_score, coalesce(c.n, 0) AS occurrences
  FROM turns q LEFT JOIN cur k ON q.qid = k.qid LEFT JOIN best c ON q.qid = c.qid AND c.r = 1"""


def n15_conflicts(d: Spark) -> str:
    """Conflicts ranked by the margin of the best challenger over the current answer and ten, its support, the question's class, less for a mere alias."""
    return f"""WITH {_groups(d, True)}, cur AS (SELECT qid, {group_score(d, "current", "cur", True)} AS score FROM scored WHERE norm = cur_norm),
  alt AS (SELECT qid, candidate, kind, pos, sources, cur_norm <> '' AND {_alias(d)} AS alias, {group_score(d, "candidate", "cand", True)} AS score FROM scored WHERE norm <> cur_norm), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS r FROM alt)
  SELECT q.qid, CASE WHEN c.qid IS NULL THEN cast(-999 AS double) ELSE round(c.score - (coalesce(k.score, 0) + 10) + least(c.sources, 12) * cast(0.8 AS double) + CASE WHEN kind IN ('yesno', 'comparison', 'number_date', 'person') THEN 4 WHEN kind = 'other' THEN -1 ELSE 0 END - CASE WHEN alias THEN 8 ELSE 0 END, 4) END AS rank_value
  FROM turns q LEFT JOIN cur k ON q.qid = k.qid LEFT JOIN best c ON q.qid = c.qid AND c.r = 1"""


def n7_v3_rules(d: Spark) -> str:
    """A country's short name where any of three priors says so, the chosen candidate where the prior was taken as safe and it is no mere alias, else the current answer."""
    norm = lambda x: t.normalized(d, x)
    china = f"contains(lower(question), 'country') AND {norm('current')} = 'peoples republic of china' AND ({norm('prior')} = 'china' OR {norm('guarded')} = 'china' OR {norm('choice')} = 'china')"
    safe = f"selected_rule = 'source_calibrated_contextual_prior_safe' AND candidate <> '' AND {norm('candidate')} <> {norm('current')} AND NOT {bad_surface(d, 'candidate')} AND NOT {minor_alias(d, 'current', 'candidate', 'false')}"
    return f"""WITH {turns(d)}, k AS (SELECT qid, CASE WHEN conv_id % 3 = 0 THEN concat('Which country is it? ', question) ELSE question END AS question, CASE WHEN turn % 4 = 0 THEN concat('People', chr(39), 's Republic of China') ELSE first END AS current, CASE WHEN conv_id % 2 = 0 THEN 'China.' ELSE third END AS prior, second AS guarded,
    CASE WHEN conv_id % 5 = 0 THEN 'the China' ELSE last END AS choice, CASE WHEN conv_id % 4 < 2 THEN 'source_calibrated_contextual_prior_safe' ELSE 'baseline' END AS selected_rule, CASE conv_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'unknown' WHEN 2 THEN two ELSE next END AS candidate FROM turns)
  SELECT qid, CASE WHEN {china} THEN 'China' WHEN {safe} THEN candidate ELSE current END AS answer, CASE WHEN {china} THEN 'country_china_alias' WHEN {safe} THEN 'prior_safe_to_choice' ELSE 'current' END AS rule FROM k"""


def short_answer(d: Spark, x: str) -> str:
    low = f"lower({x})"
    return f"({x} <> '' AND {d.size(t.tokens(d, x))} <= 8 AND length({x}) < 100 AND NOT {t.has_any(d, low, LONG_MARKS)})"


def person_expansion(d: Spark, current: str, candidate: str, question: str) -> str:
    """Whether a candidate is the current person's name in full."""
    q, a, b = f"lower(trim({question}))", t.tokens(d, current), t.tokens(d, candidate)
    asked = f"({t.starts_any(d, q, PERSON)} OR contains(substring({q}, 1, 80), ' who '))"
    # Each of the current tokens ends a token of the candidate, in order.
    pattern = f"concat('(^| )[^ ]*', replace({d.joined(a, ' ')}, ' ', '( .* | )[^ ]*'), '( |$)')"
    ordered = f"({d.joined(b, ' ')} rlike {pattern})" if d.name == "spark" else f"regexp_matches({d.joined(b, ' ')}, {pattern})"
    near = f"({ordered} OR contains({t.normalized(d, candidate)}, {t.normalized(d, current)}) OR {d.ends(d.at(b, 1), d.at(a, 1))})"
    return (
        f"coalesce({asked} AND {short_answer(d, current)} AND {short_answer(d, candidate)} AND {d.size(a)} >= 2 AND {d.size(b)} > {d.size(a)} AND {d.size(b)} <= {d.size(a)} + 3 "
        f"AND NOT {d.any(b, 'y', t.one_of(d, 'y', JOINTS))} AND NOT {t.starts_any(d, f'lower({candidate})', NO_NAMES)} AND {d.at(a, -1)} = {d.at(b, -1)} AND {near}, false)"
    )


def concise(d: Spark, current: str, candidate: str, question: str) -> str:
    """Whether a candidate is the current answer without a word that its question already says."""
    q, a, b, low = f"lower(trim({question}))", t.normalized(d, current), t.normalized(d, candidate), f"lower({current})"
    less = f"{d.size(t.tokens(d, current))} - {d.size(t.tokens(d, candidate))} = 1"
    ends = (("what genre", " composers"), ("what industry", " industry"), ("which was developed first", " computer"))
    forms = " OR ".join(f"({d.starts(q, d.lit(x))} AND {d.ends(low, d.lit(y))} AND {less})" for x, y in ends)
    series = f"(contains({q}, 'television series') AND contains({low}, ' with ') AND {d.starts(low, f'lower({candidate})')})"
    return f"({short_answer(d, current)} AND {short_answer(d, candidate)} AND {b} <> '' AND {a} <> {b} AND contains({a}, {b}) AND NOT contains({current}, ',') AND ({forms} OR {series}))"


def _first_of(candidates, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(x)} THEN {x}" for x in candidates) + " END"


def n9_meta_v2(d: Spark) -> str:
    """The chosen source, then overrides in order: agreed yes or no, a person's name in full, the prior for procedural text, a concise form."""
    q = "lower(question)"
    original = f"""CASE WHEN choice = 'contextual_prior' AND NOT {t.has_any(d, q, ("first", "older", "recent"))} THEN 'contextual_prior_safe' WHEN choice = 'reader_consensus' THEN 'reader_consensus' WHEN choice = 'graph_consensus' AND {t.starts_any(d, f"trim({q})", ("are both", "were both"))} THEN 'graph_consensus_are_both'
  WHEN conf = 'medium' AND ({t.has_any(d, "src", ("guarded", "judge"))}) THEN 'medium_guarded_or_judge' WHEN contains(src, 'prior') AND NOT contains({q}, 'released first') THEN 'prior_not_released_first' ELSE 'baseline' END"""
    verdict = t.normalized(d, "calibrated")
    both = f"(contains(concat(' ', {q}, ' '), ' both ') OR {t.starts_any(d, f'trim({q})', ('are both', 'were both', 'do both', 'did both'))})"
    return f"""WITH {turns(d)}, k AS (SELECT qid, question, first AS baseline, next AS chosen, verdict AS calibrated, concat('Dr ', first, ' ', second) AS reader, two AS full_, third AS prior, concat(two, ' composers') AS long_,
    CASE conv_id % 5 WHEN 0 THEN 'contextual_prior' WHEN 1 THEN 'reader_consensus' WHEN 2 THEN 'graph_consensus' ELSE '' END AS choice, CASE turn % 4 WHEN 0 THEN 'medium' ELSE 'high' END AS conf, CASE conv_id % 4 WHEN 0 THEN 'guarded' WHEN 1 THEN 'prior' ELSE 'reader' END AS src FROM turns),
  o AS (SELECT *, {original} AS rule0 FROM k),
  s0 AS (SELECT *, CASE WHEN rule0 IN ('contextual_prior_safe', 'reader_consensus', 'graph_consensus_are_both') THEN calibrated WHEN rule0 IN ('medium_guarded_or_judge', 'prior_not_released_first') THEN chosen WHEN qid LIKE '%0' THEN long_ WHEN qid LIKE '%2' THEN full_ WHEN qid LIKE '%4' THEN concat(first_, ' by the given triples') ELSE baseline END AS a0 FROM (SELECT *, baseline AS first_ FROM o) z),
  s1 AS (SELECT *, CASE WHEN {t.starts_any(d, f"trim({q})", YESNO)} AND {both} AND {verdict} IN ('yes', 'no') THEN {verdict} ELSE a0 END AS a1, CASE WHEN {t.starts_any(d, f"trim({q})", YESNO)} AND {both} AND {verdict} IN ('yes', 'no') THEN 'both_yesno' ELSE rule0 END AS rule1 FROM s0),
  s2 AS (SELECT *, {_first_of(("reader", "full_", "chosen"), lambda x: person_expansion(d, "a1", x, "question"))} AS person FROM s1),
  s3 AS (SELECT *, coalesce(person, a1) AS a2, CASE WHEN person IS NULL THEN rule1 ELSE 'person_expansion' END AS rule2 FROM s2),
  s4 AS (SELECT *, CASE WHEN {t.has_any(d, "lower(a2)", PROCEDURAL)} AND {short_answer(d, "prior")} THEN prior ELSE a2 END AS a3, CASE WHEN {t.has_any(d, "lower(a2)", PROCEDURAL)} AND {short_answer(d, "prior")} THEN 'procedural_prior' ELSE rule2 END AS rule3 FROM s3),
  s5 AS (SELECT *, {_first_of(("prior", "full_", "chosen"), lambda x: concise(d, "a3", x, "question"))} AS shorter FROM s4)
  SELECT qid, coalesce(shorter, a3) AS answer, CASE WHEN shorter IS NULL THEN rule3 ELSE 'concise_canonical' END AS rule, rule0 AS original_rule FROM s5"""


def n10_reader_fallback(d: Spark) -> str:
    """A prior that isn't bad where the reader agrees with nobody, then the guarded answer where the reader is bad or long, else the reader."""
    same = " OR ".join(f"({x} <> '' AND {t.normalized(d, 'reader')} = {t.normalized(d, x)})" for x in ("guarded", "judge", "context", "prior"))
    return f"""WITH {turns(d)}, k AS (SELECT qid, CASE WHEN turn % 4 = 2 THEN concat(question, ' and nothing more') ELSE first END AS reader, CASE WHEN conv_id % 3 = 0 THEN first ELSE second END AS guarded, verdict AS judge, CASE WHEN conv_id % 4 = 0 THEN {d.upper("first")} ELSE '' END AS context, CASE WHEN conv_id % 5 = 0 THEN 'None of it' ELSE third END AS prior FROM turns),
  r AS (SELECT *, CASE WHEN NOT ({same}) AND NOT {bad_fallback(d, "prior")} THEN 'prior' WHEN {bad_fallback(d, "reader")} OR {t.n_words(d, "reader")} > 8 THEN 'guarded' ELSE 'reader' END AS rule FROM k)
  SELECT qid, rule, CASE rule WHEN 'prior' THEN prior WHEN 'guarded' THEN guarded ELSE reader END AS answer FROM r"""


def n11_guarded(d: Spark) -> str:
    """The judge where the current answer is bad, or where the prior agrees with it and both differ from the current one, unless it only shortens; then the contextual prior for what is still bad."""
    norm = lambda x: t.normalized(d, x)
    cur, jud = t.tokens(d, "cur"), t.tokens(d, "judge")
    shorter = f"({d.size(jud)} > 0 AND {t.subset(d, jud, cur)} AND NOT {t.subset(d, cur, jud)} AND NOT {bad_fallback(d, 'cur')})"
    return f"""WITH {turns(d)}, k AS (SELECT qid, CASE WHEN conv_id % 6 = 0 THEN 'Insufficient data' WHEN conv_id % 2 = 0 THEN two ELSE first END AS cur, CASE WHEN conv_id % 12 = 0 THEN 'neither' WHEN turn % 4 = 0 THEN second ELSE third END AS judge, CASE WHEN conv_id % 3 = 1 THEN '' ELSE second END AS prior, last AS contextual FROM turns),
  s AS (SELECT *, ({bad_fallback(d, "cur")} OR (prior <> '' AND {norm("prior")} = {norm("judge")} AND {norm("judge")} <> {norm("cur")})) AND NOT {shorter} AS judged FROM k), p AS (SELECT *, CASE WHEN judged THEN judge ELSE cur END AS chosen FROM s)
  SELECT qid, CASE WHEN {bad_fallback(d, "chosen")} AND NOT {bad_fallback(d, "contextual")} THEN contextual ELSE chosen END AS answer, CASE WHEN {bad_fallback(d, "chosen")} AND NOT {bad_fallback(d, "contextual")} THEN 'contextual_prior' WHEN judged THEN 'judge' ELSE 'current' END AS rule FROM p"""


def n14_choices(d: Spark) -> str:
    """A chosen label resolved to its candidate, or why the current answer stays."""
    rank = "CASE conf WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"
    return f"""WITH {turns(d)}, k AS (SELECT qid, first, concat('C', cast(1 + conv_id % 4 AS string)) AS label, CASE turn % 8 WHEN 0 THEN 'high' WHEN 2 THEN 'medium' WHEN 4 THEN 'low' ELSE '' END AS conf, CASE conv_id % 7 WHEN 0 THEN 'There is no evidence of it' ELSE 'it says so' END AS why, CASE 1 + conv_id % 4 WHEN 2 THEN second WHEN 3 THEN CASE WHEN turn % 4 = 0 THEN two ELSE 'unknown' END END AS selected FROM turns),
  r AS (SELECT *, CASE WHEN label NOT IN ('C1', 'C2', 'C3') THEN 'invalid_choice' WHEN label = 'C1' THEN 'chose_current' WHEN {rank} < 2 THEN 'low_confidence' WHEN {bad_surface(d, "selected", 14, 220)} THEN 'bad_surface' WHEN {minor_alias(d, 'first', 'selected', 'false')} THEN 'minor_alias' WHEN {t.has_any(d, "lower(why)", ABSENCE)} THEN 'absence_reason' ELSE 'accepted' END AS reason FROM k)
  SELECT qid, reason, CASE WHEN reason = 'accepted' THEN selected ELSE first END AS answer FROM r"""


# Months and number words that count as numbers, and what keeps the current answer.
MONTHS = "(january|february|march|april|may|june|july|august|september|october|november|december)"
NUMBER_WORDS = "(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|hundred|thousand|million)"
KEEPING = ("current answer is correct", "current is correct", "keep current", "current already")
PLACES = ("city", "county", "state", "province", "country", "region")
BEARINGS = ("united", "south", "north", "east", "west")


def compacted(d: Spark, x: str) -> str:
    return d.rep(f"lower(coalesce({x}, ''))", "[^a-z0-9]+")


def kind_reason(d: Spark, kind: str, question: str, answer: str) -> str:
    """Why an answer isn't of the kind that its question asks for; null if it is."""
    q, norm, low = f"lower({question})", t.normalized(d, answer), f"lower({answer})"
    word = lambda p: d.rlike(low, f"(^|[^a-z0-9]){p}($|[^a-z0-9])")
    return (
        f"CASE WHEN {kind} = 'yesno' AND {norm} NOT IN ('yes', 'no') THEN 'yesno_not_binary' WHEN {d.starts(q, d.lit('how many'))} AND {d.rlike(f'trim({answer})', '^(1[0-9]{3}|20[0-9]{2})$')} THEN 'how_many_year' "
        f"WHEN contains({q}, 'which president') AND NOT {d.rlike(low, '(^|[^a-z0-9])[0-9]{1,2}(st|nd|rd|th)($|[^a-z0-9])')} THEN 'president_without_ordinal' WHEN {kind} = 'number_date' AND NOT ({d.rlike(answer, '[0-9]')} OR {word(MONTHS)} OR {word(NUMBER_WORDS)}) THEN 'number_date_without_number' "
        f"WHEN {kind} = 'location' AND {d.rlike(answer, '(^|[^A-Za-z])(University|Airline|Company|Corporation|Inc|Ltd)($|[^A-Za-z])')} THEN 'location_org_like' END"
    )


def in_quotes(d: Spark, answer: str, quotes: str, question: str, kind: str) -> str:
    """Whether quotes hold an answer: whole, or its tokens (all of at most two, else three of four); a comparison's may stand in the question."""
    norm, held, tokens = t.normalized(d, answer), t.normalized(d, quotes), t.tokens(d, answer)
    met, n = d.size(d.filter(tokens, "y", f"contains({held}, y)")), d.size(tokens)
    return f"({norm} <> '' AND (contains({held}, {norm}) OR ({kind} = 'comparison' AND contains({t.normalized(d, question)}, {norm})) OR {met} >= CASE WHEN {n} <= 2 THEN cast({n} AS double) ELSE cast(0.75 AS double) * {n} END))"


def quoted(d: Spark, quote: str, passage: str) -> str:
    """Whether a quote of at least 16 compact characters stands in the passage."""
    return f"(length({compacted(d, quote)}) >= 16 AND contains({compacted(d, passage)}, {compacted(d, quote)}))"


def place_mismatch(d: Spark, question: str, proposed: str, current: str) -> str:
    """A place is asked for, the current answer looks like one, and the proposed one doesn't."""
    asks, low = t.has_any(d, f"lower({question})", ("where", "what city", "what country", "what region", "headquartered", "located")), f"lower({proposed})"
    return f"({asks} AND NOT {bad_surface(d, current)} AND NOT {t.has_any(d, low, PLACES)} AND NOT contains({proposed}, ',') AND NOT {t.has_any(d, low, BEARINGS)} AND (contains({current}, ',') OR {t.has_any(d, f'lower({current})', PLACES)}) AND {d.size(t.tokens(d, proposed))} <= 4)"


def gates(d: Spark) -> dict[str, list[tuple[str, str]]]:
    """The eight acceptance gates, each a list of what fails an answer and its reason, in order.

    They read question, kind, current, proposed, should_switch, action, conf, sufficient, why, source, quote_1, quote_2, passage, known (is a candidate) and before (an earlier gate's reason).
    """
    same, bad = f"{t.normalized(d, 'proposed')} = {t.normalized(d, 'current')}", bad_surface(d, "proposed")
    rank = "CASE conf WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"
    off_kind, held = kind_reason(d, "kind", "question", "proposed"), in_quotes(d, "proposed", "passage", "question", "kind")
    verbatim = f"NOT ({quoted(d, 'quote_1', 'passage')} AND {quoted(d, 'quote_2', 'passage')})"
    spans = d.all("question", '"([^"]{3,80})"', 1)
    uncovered = f"{d.size(d.filter(spans, 's', 'NOT contains(lower(passage), lower(s))'))} > 0"
    keeps = t.has_any(d, "lower(why)", KEEPING)
    one = f"CASE WHEN contains({t.normalized(d, 'quote_1')}, {t.normalized(d, 'proposed')}) THEN quote_1 WHEN contains({t.normalized(d, 'quote_2')}, {t.normalized(d, 'proposed')}) THEN quote_2 ELSE '' END"
    org = d.rlike("proposed", r"^([Tt]he )?[A-Z][A-Za-z0-9 .'-]+( University| Airline| Airport| Company| Corporation)$")
    start = [(same, "'same_as_current'")]
    high, switch, action = ("conf <> 'high'", "'not_high_confidence'"), ("NOT should_switch", "'should_switch_false'"), ("action <> 'switch'", "'action_not_switch'")
    return {
        "type_aware": [*start, (bad, "'bad_surface'"), switch, (f"{rank} < 2", "'low_confidence'"), (f"{off_kind} IS NOT NULL", off_kind), (f"NOT {held}", "'not_grounded'")],
        "two_stage": [("NOT sufficient", "'locator_insufficient'"), (uncovered, "'missing_quoted_constraint'"), *start, (bad, "'bad_surface'"), switch, (f"{rank} < 2", "'low_confidence'"), (f"{off_kind} IS NOT NULL", off_kind), (f"NOT {held}", "'not_grounded'")],
        "strict_quote": [*start, high, switch, (bad, "'bad_surface'"), (verbatim, "'quote_not_verbatim'"), (f"NOT {in_quotes(d, 'proposed', 'concat(quote_1, chr(32), quote_2)', 'question', 'kind')}", "'answer_not_quote_grounded'"), (f"kind = 'comparison' AND NOT contains({t.normalized(d, 'question')}, {t.normalized(d, 'proposed')}) AND {t.normalized(d, 'proposed')} NOT IN ('yes', 'no')", "'comparison_not_option'")],
        "kg_challenger": [*start, action, high, (keeps, "'reason_keeps_current'"), (bad, "'bad_surface'"), ("NOT known", "'not_kg_candidate'"), (verbatim, "'quote_not_verbatim'")],
        "focused_passage": [*start, high, switch, (bad, "'bad_surface'"), (f"kind = 'location' AND {org}", "'location_org_like'"), (f"NOT {held}", "'not_grounded'")],
        "conservative": [*start, action, high, (bad, "'bad_surface'"), ("NOT known", "'not_candidate'")],
        "conservative_v2": [*start, action, high, (bad, "'bad_surface'"), ("contains(source, 'reader_v1') AND NOT contains(source, 'support')", "'reader_only_source'"), (place_mismatch(d, "question", "proposed", "current"), "'location_type_mismatch'")],
        "strict_quote_v2": [("before <> 'accepted'", "before"), *start, (keeps, "'reason_keeps_current'"), (f"contains(lower(question), 'which film') AND {one} <> '' AND NOT contains(lower({one}), 'film')", "'film_type_mismatch'")],
    }


def gate_reason(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {reason}" for test, reason in rules) + " ELSE 'accepted' END"


def n13_acceptance(d: Spark) -> str:
    """What each of the eight gates says to a proposed answer: the first reason against it, or accepted."""
    found = gates(d)
    last = found.pop("strict_quote_v2")
    reasons = ", ".join(f"{gate_reason(rules)} AS {name}" for name, rules in found.items())
    return f"""WITH {turns(d)}, told_text AS (SELECT conv_id, turn - 1 AS turn, text AS passage FROM conversations WHERE role = 'assistant'),
  k AS (SELECT q.qid, concat(CASE q.conv_id % 11 WHEN 0 THEN 'Which film is it? ' WHEN 1 THEN concat('Who said "', second, ' ', third, '"? ') WHEN 2 THEN 'How many are there? ' ELSE '' END, question) AS question, CASE WHEN q.conv_id % 5 = 0 THEN concat(first, ', a city') ELSE first END AS current,
    CASE (q.conv_id + q.turn) % 7 WHEN 0 THEN first WHEN 1 THEN 'unknown' WHEN 2 THEN '1999' WHEN 3 THEN concat(second, ' University') WHEN 4 THEN verdict ELSE next END AS proposed, q.turn % 8 <> 2 AS should_switch, CASE WHEN q.conv_id % 6 = 5 THEN 'keep' ELSE 'switch' END AS action,
    CASE WHEN q.conv_id % 4 = 1 THEN 'medium' WHEN q.turn % 10 = 6 THEN 'low' ELSE 'high' END AS conf, q.conv_id % 10 <> 3 AS sufficient, CASE WHEN q.conv_id % 9 = 4 THEN 'Current is correct.' ELSE 'it says so' END AS why, CASE WHEN q.conv_id % 8 = 7 THEN 'reader_v1' ELSE 'reader_v1 support_fallback' END AS source,
    coalesce(substring(p.passage, 1, 60), '') AS quote_1, CASE WHEN q.conv_id % 7 = 6 THEN 'words that nobody said here' ELSE coalesce(substring(p.passage, 5, 50), '') END AS quote_2, coalesce(p.passage, '') AS passage, (q.conv_id + q.turn) % 7 <> 4 AS known
    FROM turns q LEFT JOIN told_text p ON q.conv_id = p.conv_id AND q.turn = p.turn), kinds AS (SELECT *, {question_kind(d, "question")} AS kind FROM k),
  judged AS (SELECT *, {reasons} FROM kinds), final AS (SELECT *, strict_quote AS before FROM judged) SELECT qid, {", ".join(found)}, {gate_reason(last)} AS strict_quote_v2 FROM final"""


QUERIES = (n6_selector, n7_v3_rules, n9_meta_v2, n10_reader_fallback, n11_guarded, n13_acceptance, n14_choices, n15_conflicts)
