"""Audit and statistics plans. Each function gives the SQL of one query for an engine."""

from __future__ import annotations

from veritrail.functions import text as t
from veritrail.functions.dialect import Spark
from veritrail.plans import views as v

METRICS = "cast(count(*) AS bigint) AS n, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1"
#: The signals that triage compares; higher means more risk.
SIGNALS = {
    "audit_risk_score": "cast(risk_score AS double)",
    "graph_audit_score": "cast(graph_score AS double)",
    "answer_not_selected": "cast(CASE WHEN selected THEN 0 ELSE 1 END AS double)",
    "chain_incomplete": "cast(CASE WHEN complete THEN 0 ELSE 1 END AS double)",
    "residual_graph_gap": "cast(CASE WHEN residual THEN 1 ELSE 0 END AS double)",
    "unrepaired_incomplete": "cast(CASE WHEN unrepaired THEN 1 ELSE 0 END AS double)",
}
GAPS = ("complete", "missing_entities", "disconnected", "short_chain")


def rate(x: str) -> str:
    return f"round(avg(CASE WHEN {x} THEN cast(1 AS double) ELSE cast(0 AS double) END), 4)"


def _with(d: Spark, *parts: str) -> str:
    return "WITH " + ",".join(parts)


def g10_risk_bins(d: Spark) -> str:
    from veritrail.functions.classify import risk_bin

    return f"""{_with(d, v.audit(d))} SELECT {risk_bin("risk_score")} AS risk_bin, {METRICS}, round(avg(1 - em), 4) AS error_rate, {rate("selected")} AS selected_rate,
  {rate("complete")} AS chain_complete_rate, {rate("unrepaired")} AS unrepaired_rate FROM audit GROUP BY 1 ORDER BY 1"""


def k5_audit_rows(d: Spark) -> str:
    """States, gaps, components and scores of every row."""
    return f"{_with(d, v.audit(d))} SELECT qid, type, em, f1, state, gap, complete, selected, residual, unrepaired, cast(graph_score AS bigint) AS graph_score, cast(risk_score AS bigint) AS risk_score FROM audit"


def g8_audit_states(d: Spark) -> str:
    return f"""{_with(d, v.audit(d))}, totals AS (SELECT count(*) AS total FROM audit), grouped AS (
  SELECT 'state' AS kind, state AS label, {METRICS} FROM audit GROUP BY state UNION ALL SELECT 'gap', gap, {METRICS} FROM audit GROUP BY gap)
  SELECT kind, label, n, round(cast(n AS double) / total, 4) AS rate, em, f1 FROM grouped JOIN totals ON true"""


def g8_overview(d: Spark) -> str:
    repaired = "repair_steps <> ''"
    return f"""{_with(d, v.audit(d))} SELECT dataset, cast(count(*) AS bigint) AS n, {rate("complete")} AS complete_rate, {rate(repaired)} AS repair_rate,
  round(coalesce(sum(CASE WHEN {repaired} AND complete THEN cast(1 AS double) ELSE cast(0 AS double) END) / nullif(sum(CASE WHEN {repaired} THEN 1 ELSE 0 END), 0), 0), 4) AS repair_to_complete,
  {rate("fallback_steps <> ''")} AS fallback_rate, {rate("selected")} AS selected_rate FROM audit GROUP BY dataset"""


def g9_label_consistency(d: Spark) -> str:
    rule = "CASE WHEN gap = 'complete' THEN complete ELSE NOT complete END AND NOT (gap = 'short_chain' AND repair_steps <> '')"
    return f"""{_with(d, v.audit(d))}, ruled AS (SELECT gap, em, f1, {rule} AS ok FROM audit)
  SELECT gap, cast(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS bigint) AS consistent_n, cast(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS bigint) AS inconsistent_n, {rate("ok")} AS rate, round(avg(em), 4) AS em, round(avg(f1), 4) AS f1 FROM ruled GROUP BY gap"""


def _signals(d: Spark) -> str:
    each = " UNION ALL ".join(f"SELECT qid, em, '{k}' AS signal, {x} AS value FROM audit" for k, x in SIGNALS.items())
    return f"signals AS ({each})"


def g11_auc(d: Spark) -> str:
    """Rank sums with average ranks: counts per value first, so that no window holds all rows."""
    return f"""{_with(d, v.audit(d), _signals(d))}, counts AS (SELECT signal, value, count(*) AS m, sum(CASE WHEN em < 1 THEN 1 ELSE 0 END) AS bad FROM signals GROUP BY signal, value),
  ranked AS (SELECT *, sum(m) OVER (PARTITION BY signal ORDER BY value) - m + (m + 1) / cast(2 AS double) AS avg_rank FROM counts),
  sums AS (SELECT signal, sum(bad * avg_rank) AS r, cast(sum(bad) AS double) AS n1, cast(sum(m - bad) AS double) AS n0 FROM ranked GROUP BY signal)
  SELECT signal, CASE WHEN n1 = 0 OR n0 = 0 THEN cast(0.5 AS double) ELSE round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 4) END AS auc FROM sums"""


def g12_triage(d: Spark) -> str:
    """Errors among the fifth of the rows that a signal puts first, and how much more often they are wrong than all."""
    # By value, then by the first figures of the id as text: no task sorts all rows of a signal.
    ranked = v.placed("ranked", "signals", "k.value DESC, cast(k.qid AS string) DESC", "concat(lpad(cast(cast(round(value * 1000000) AS bigint) + 1000000000000 AS string), 14, '0'), ' ', substring(cast(qid AS string), 1, 3))", "bucket_ DESC", "signal")
    return f"""{_with(d, v.audit(d), _signals(d), ranked)},
  summed AS (SELECT signal, cast(sum(CASE WHEN pos <= ceil(total * cast(0.2 AS double)) THEN 1 ELSE 0 END) AS bigint) AS top_n, sum(CASE WHEN pos <= ceil(total * cast(0.2 AS double)) THEN 1 - em ELSE 0 END) AS top_errors, avg(1 - em) AS base FROM ranked GROUP BY signal)
  SELECT signal, top_n, cast(top_errors AS bigint) AS top_error_n, round(top_errors / top_n, 4) AS top_error_rate, round(coalesce(top_errors / top_n / nullif(base, 0), 0), 4) AS lift FROM summed"""


def e10_prefixes(d: Spark) -> str:
    """Metrics of the first rows, by how many; a size beyond the table has none."""
    sizes = " UNION ALL ".join(f"SELECT {n} AS size" for n in (50, 100, 200, 399, 1000))
    return f"""{_with(d, v.audit(d))}, first AS (SELECT * FROM audit ORDER BY qid LIMIT 1000), placed AS (SELECT *, row_number() OVER (ORDER BY qid) AS pos FROM first), whole AS (SELECT count(*) AS total FROM audit), sizes AS ({sizes})
  SELECT cast(size AS bigint) AS size, {METRICS}, {rate("complete")} AS complete_rate FROM placed JOIN whole ON true JOIN sizes ON pos <= size AND total >= size GROUP BY size"""


def g13_conditional(d: Spark) -> str:
    return f"{_with(d, v.audit(d))} SELECT selected, cast(graph_score AS bigint) AS graph_score, {METRICS}, round(avg(1 - em), 4) AS error FROM audit GROUP BY selected, graph_score"


def g14_grouped(d: Spark) -> str:
    """Four groupings in one pass."""
    return f"""{_with(d, v.audit(d))} SELECT CASE WHEN grouping(complete) = 0 THEN 'chain' WHEN grouping(gap) = 0 THEN 'gap' WHEN grouping(repair_steps) = 0 THEN 'repair' ELSE 'type' END AS grouped_by,
  coalesce(CASE WHEN complete THEN 'complete' WHEN NOT complete THEN 'incomplete' END, gap, repair_steps, type) AS label, {METRICS} FROM audit GROUP BY GROUPING SETS ((complete), (gap), (repair_steps), (type))"""


def g15_proxies(d: Spark) -> str:
    """Precision, recall, prevalence and lift of each label against errors."""
    labels = " UNION ALL ".join(f"SELECT '{g}' AS label" for g in GAPS)
    div = lambda a, b: f"coalesce(cast({a} AS double) / nullif({b}, 0), 0)"
    return f"""{_with(d, v.audit(d))}, labels_of AS ({labels}), counts AS (SELECT label, sum(CASE WHEN gap = label THEN 1 ELSE 0 END) AS label_n, sum(CASE WHEN em < 1 THEN 1 ELSE 0 END) AS target_n,
  sum(CASE WHEN gap = label AND em < 1 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM labels_of JOIN audit ON true GROUP BY label)
  SELECT label, cast(label_n AS bigint) AS label_n, cast(target_n AS bigint) AS target_n, cast(tp AS bigint) AS tp, round({div("tp", "label_n")}, 4) AS precision_, round({div("tp", "target_n")}, 4) AS recall_,
  round({div("target_n", "n")}, 4) AS prevalence, round(coalesce({div("tp", "label_n")} / nullif({div("target_n", "n")}, 0), 0), 4) AS lift FROM counts"""


def wilson(k: str, n: str, z: float, sign: int) -> str:
    z = f"cast({z!r} AS double)"
    p = f"(cast({k} AS double) / {n})"
    return f"(({p} + {z} * {z} / (2 * {n}) {'+' if sign > 0 else '-'} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n}))"


def g16_wilson(d: Spark) -> str:
    """Queue rates with both interval forms."""
    queues = {"selected_incomplete": "selected AND NOT complete", "residual": "residual", "unrepaired": "unrepaired", "unselected": "NOT selected"}
    each = " UNION ALL ".join(f"SELECT '{q}' AS queue, sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS k, cast(count(*) AS double) AS n FROM audit" for q, x in queues.items())
    return f"""{_with(d, v.audit(d))}, queues AS ({each}) SELECT queue, cast(k AS bigint) AS k, cast(n AS bigint) AS n, round({wilson("k", "n", 1.96, -1)}, 6) AS low, round({wilson("k", "n", 1.96, 1)}, 6) AS high,
  round(greatest(cast(0 AS double), {wilson("k", "n", 1.959963984540054, -1)}), 4) AS low_clamped, round(least(cast(1 AS double), {wilson("k", "n", 1.959963984540054, 1)}), 4) AS high_clamped FROM queues"""


def g17_newcombe(d: Spark) -> str:
    lo1, hi1, lo2, hi2 = (wilson(k, n, 1.959963984540054, s) for k, n, s in (("k1", "n1", -1), ("k1", "n1", 1), ("k2", "n2", -1), ("k2", "n2", 1)))
    p1, p2 = "(k1 / n1)", "(k2 / n2)"
    return f"""{_with(d, v.audit(d))}, k AS (SELECT type, cast(sum(CASE WHEN selected THEN em ELSE 0 END) AS double) AS k1, cast(sum(CASE WHEN selected THEN 1 ELSE 0 END) AS double) AS n1,
  cast(sum(CASE WHEN complete THEN em ELSE 0 END) AS double) AS k2, cast(sum(CASE WHEN complete THEN 1 ELSE 0 END) AS double) AS n2 FROM audit GROUP BY type)
  SELECT type, round({p1} - {p2}, 4) AS delta, round({p1} - {p2} - sqrt(power({p1} - {lo1}, 2) + power({hi2} - {p2}, 2)), 4) AS low, round({p1} - {p2} + sqrt(power({hi1} - {p1}, 2) + power({p2} - {lo2}, 2)), 4) AS high FROM k WHERE n1 > 0 AND n2 > 0"""


def g6_mcnemar(d: Spark) -> str:
    """Outcomes of two systems on shared ids: rows paired by order within a language."""
    if d.name == "duck":
        tail = "least(1.0::double, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::double))) FROM range(0, least(b, c) + 1) r(i)))"
        p = f"CASE WHEN b + c = 0 THEN 1.0::double ELSE round({tail}, 6) END"
    else:
        steps = "aggregate(sequence(0L, least(b, c)), named_struct('term', -(b + c) * ln(2D), 'total', 0D), (s, i) -> named_struct('term', s.term + CASE WHEN i = 0 THEN 0D ELSE ln((b + c - i + 1) / cast(i AS double)) END, 'total', s.total + exp(s.term + CASE WHEN i = 0 THEN 0D ELSE ln((b + c - i + 1) / cast(i AS double)) END)), s -> s.total)"
        p = f"CASE WHEN b + c = 0 THEN 1D ELSE round(least(1D, 2 * {steps}), 6) END"
    return f"""{_with(d, v.audit(d))}, placed AS (SELECT type, em, f1, selected, row_number() OVER (PARTITION BY type ORDER BY qid) AS pos FROM audit),
  joined AS (SELECT x.type, x.em AS a, y.em AS z FROM placed x JOIN placed y ON y.type = x.type AND y.pos = x.pos + 1 WHERE x.pos % 2 = 1),
  counts AS (SELECT type, sum(CASE WHEN a = 1 AND z = 1 THEN 1 ELSE 0 END) AS both_n, sum(CASE WHEN a = 1 AND z < 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN a < 1 AND z = 1 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN a < 1 AND z < 1 THEN 1 ELSE 0 END) AS neither, count(*) AS n FROM joined GROUP BY type),
  whole AS (SELECT type, cast(both_n AS bigint) AS both_n, cast(b AS bigint) AS b, cast(c AS bigint) AS c, cast(neither AS bigint) AS neither, cast(n AS bigint) AS n FROM counts)
  SELECT type, n, both_n, b AS primary_only, c AS baseline_only, neither, round(cast(b - c AS double) / n, 4) AS delta_em, {p} AS p FROM whole"""


def g5_bootstrap(d: Spark) -> str:
    """Percentile intervals of resampled means: each row enters a resample as often as a Poisson draw says, by an arithmetic generator that both engines share.

    So no row moves: tasks sum their rows for each type and resample, and only sums are shuffled.
    """
    reps, seed = 200, 12345
    series = "(SELECT explode(sequence(0L, {0} - 1)) AS rep)" if d.name == "spark" else "(SELECT range AS rep FROM range(0, {0}))"
    # Where the distribution function of Poisson(1) steps, in millionths.
    steps = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)
    times = " + ".join(f"CASE WHEN draw >= {x} THEN 1 ELSE 0 END" for x in steps)
    return f"""{_with(d, v.audit(d))}, keyed AS (SELECT type, em, f1, qid % 1000003 AS h FROM audit), drawn AS (SELECT type, em, f1, rep, ({seed} + (rep + 1) * 7919 + h * 104729 + (rep + 1) * h * 31 + h * h * 17 + (rep + 1) * (rep + 1) * 613) % 1000003 AS draw FROM keyed JOIN {series.format(reps)} r ON true),
  counted AS (SELECT type, rep, em, f1, {times} AS n FROM drawn), means AS (SELECT type, rep, round(sum(n * em) / sum(n), 9) AS em, round(sum(n * f1) / sum(n), 9) AS f1 FROM counted GROUP BY type, rep HAVING sum(n) > 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY em) - 1 AS r_em, row_number() OVER (PARTITION BY type ORDER BY f1) - 1 AS r_f1, count(*) OVER (PARTITION BY type) AS reps FROM means),
  point AS (SELECT type, avg(em) AS em, avg(f1) AS f1 FROM audit GROUP BY type)
  SELECT r.type, round(min(p.em), 4) AS em, round(max(CASE WHEN r_em = floor((reps - 1) * cast(0.025 AS double)) THEN r.em END), 4) AS em_low, round(max(CASE WHEN r_em = floor((reps - 1) * cast(0.975 AS double)) THEN r.em END), 4) AS em_high,
  round(min(p.f1), 4) AS f1, round(max(CASE WHEN r_f1 = floor((reps - 1) * cast(0.025 AS double)) THEN r.f1 END), 4) AS f1_low, round(max(CASE WHEN r_f1 = floor((reps - 1) * cast(0.975 AS double)) THEN r.f1 END), 4) AS f1_high FROM ranked r JOIN point p ON r.type = p.type GROUP BY r.type"""


def _reviews(d: Spark) -> str:
    """Three rule reviewers of a gap label: by the gold chain, by what the reader saw, and a cautious one."""
    strict = """CASE gap WHEN 'complete' THEN CASE WHEN pair_recall >= 0.999 AND connected THEN 'match' ELSE 'mismatch' END
    WHEN 'missing_entities' THEN CASE WHEN entity_coverage < 0.999 THEN 'match' ELSE 'mismatch' END
    WHEN 'disconnected' THEN CASE WHEN entity_coverage >= 0.999 AND NOT connected THEN 'match' WHEN relation_recall < 0.999 AND pair_recall >= 0.999 THEN 'ambiguous' ELSE 'mismatch' END
    WHEN 'short_chain' THEN CASE WHEN pair_recall > 0 AND pair_recall < 0.999 THEN 'match' ELSE 'mismatch' END ELSE 'ambiguous' END"""
    seen = "(support_recall >= 0.999 AND reader_coverage >= 0.9)"
    support = f"""CASE gap WHEN 'complete' THEN CASE WHEN {seen} AND (em > 0 OR pair_recall >= 0.999) THEN 'match' ELSE 'ambiguous' END
    WHEN 'missing_entities' THEN CASE WHEN {seen} AND entity_coverage < 0.999 THEN 'match' WHEN NOT {seen} THEN 'ambiguous' ELSE 'mismatch' END
    WHEN 'disconnected' THEN CASE WHEN entity_coverage >= 0.999 AND pair_recall < 0.999 THEN 'match' ELSE 'ambiguous' END
    WHEN 'short_chain' THEN CASE WHEN pair_recall > 0 AND pair_recall < 0.999 THEN 'match' ELSE 'mismatch' END ELSE 'ambiguous' END"""
    good = "((em >= 1 OR f1 >= 0.8) AND support_recall >= 0.999)"
    cautious = f"""CASE gap WHEN 'complete' THEN CASE WHEN {good} AND (pair_recall >= 0.999 OR connected) THEN 'match' WHEN {good} THEN 'ambiguous' ELSE 'mismatch' END
    WHEN 'missing_entities' THEN CASE WHEN entity_coverage < 0.999 AND pair_recall < 0.999 THEN 'match' ELSE 'ambiguous' END
    WHEN 'disconnected' THEN CASE WHEN entity_coverage >= 0.999 AND (NOT connected OR relation_recall < 0.999) THEN 'match' ELSE 'ambiguous' END
    WHEN 'short_chain' THEN CASE WHEN pair_recall > 0 AND pair_recall < 0.999 THEN 'match' ELSE 'ambiguous' END ELSE 'ambiguous' END"""
    return f"{gold(d)}, reviews AS (SELECT qid, gap, {strict} AS a, {support} AS b, {cautious} AS c FROM gold)"


def gold(d: Spark) -> str:
    """Gold metrics of each audited row, derived from its length."""
    part = lambda n, k: f"round(cast((n_chars * {k}) % {n} AS double) / {n - 1}, 4)"
    return f"""gold AS (SELECT *, {part(3, 1)} AS entity_coverage, {part(4, 3)} AS pair_recall, {part(5, 3)} AS relation_recall, {part(2, 1)} AS support_recall, {part(7, 5)} AS reader_coverage, n_chars % 6 < 3 AS connected FROM audit)"""


def g20_majority(d: Spark) -> str:
    n = lambda k: "(" + " + ".join(f"CASE WHEN {x} = '{k}' THEN 1 ELSE 0 END" for x in "abc") + ")"
    return f"""{_with(d, v.audit(d), _reviews(d))} SELECT qid, a, b, c, CASE WHEN {n("match")} >= 2 THEN 'match' WHEN {n("mismatch")} >= 2 THEN 'mismatch' ELSE 'ambiguous' END AS majority,
  CASE WHEN greatest({n("match")}, {n("mismatch")}, {n("ambiguous")}) = 3 THEN 'high' WHEN greatest({n("match")}, {n("mismatch")}, {n("ambiguous")}) = 2 THEN 'medium' ELSE 'low' END AS confidence, NOT (a = b AND b = c) AS disagreement FROM reviews"""


def g19_agreement(d: Spark) -> str:
    return f"{_with(d, v.audit(d), _reviews(d))} SELECT {rate('a = b')} AS a_b, {rate('a = c')} AS a_c, {rate('b = c')} AS b_c FROM reviews"


def g18_kappa(d: Spark) -> str:
    n = lambda k: "cast(" + " + ".join(f"CASE WHEN {x} = '{k}' THEN 1 ELSE 0 END" for x in "abc") + " AS double)"
    return f"""{_with(d, v.audit(d), _reviews(d))}, counts AS (SELECT {n("match")} AS m, {n("mismatch")} AS x, {n("ambiguous")} AS u FROM reviews),
  agreed AS (SELECT avg((m * (m - 1) + x * (x - 1) + u * (u - 1)) / 6) AS p, power(sum(m) / (3 * count(*)), 2) + power(sum(x) / (3 * count(*)), 2) + power(sum(u) / (3 * count(*)), 2) AS pe, count(*) AS n FROM counts)
  SELECT cast(n AS bigint) AS n, round(p, 4) AS observed, round(pe, 4) AS expected, CASE WHEN pe >= 1 THEN cast(1 AS double) ELSE round((p - pe) / (1 - pe), 4) END AS kappa FROM agreed"""


def g24_transitions(d: Spark) -> str:
    new = "CASE WHEN selected AND NOT complete THEN 'repaired' WHEN complete THEN 'kept' ELSE 'residual' END"
    return f"""{_with(d, v.audit(d))}, moved AS (SELECT state, {new} AS new_state FROM audit)
  SELECT state, cast(sum(CASE WHEN new_state = 'kept' THEN 1 ELSE 0 END) AS bigint) AS kept, cast(sum(CASE WHEN new_state = 'repaired' THEN 1 ELSE 0 END) AS bigint) AS repaired,
  cast(sum(CASE WHEN new_state = 'residual' THEN 1 ELSE 0 END) AS bigint) AS residual, round({100} * avg(CASE WHEN new_state = 'kept' THEN cast(1 AS double) ELSE cast(0 AS double) END), 2) AS kept_pct FROM moved GROUP BY state"""


def g26_histogram(d: Spark) -> str:
    kinds = {"type": "type", "gap": "gap", "state": "state", "selected": "CASE WHEN selected THEN 'yes' ELSE 'no' END"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS kind, {x} AS value, cast(count(*) AS bigint) AS n FROM audit GROUP BY {x}" for k, x in kinds.items())
    return f"{_with(d, v.audit(d))} {each}"


def g29_contrast(d: Spark) -> str:
    """Mean score of right and wrong rows, and the gain of converged ones."""
    avg_if = lambda x, c: f"round(avg(CASE WHEN {c} THEN {x} END), 4)"
    return f"{_with(d, v.audit(d))} SELECT {avg_if('em', 'complete')} AS em_converged, {avg_if('em', 'NOT complete')} AS em_not, {avg_if('f1', 'em = 1')} AS score_right, {avg_if('f1', 'em < 1')} AS score_wrong FROM audit"


def g1_run_summary(d: Spark) -> str:
    return f"{_with(d, v.audit(d))} SELECT dataset AS mode, {METRICS}, round(avg(1 + cast(qid % 4 AS double)), 2) AS avg_iter FROM audit GROUP BY dataset"


def g2_usage(d: Spark) -> str:
    fresh = lambda x: f"round(coalesce(avg(CASE WHEN NOT cached THEN {x} END), avg({x}), 0), 4)"
    return f"{_with(d, v.usage(d))} SELECT mode, cast(count(*) AS bigint) AS n, cast(sum(CASE WHEN cached THEN 0 ELSE 1 END) AS bigint) AS fresh_n, {fresh('tokens')} AS avg_tokens, {fresh('wall_time')} AS avg_wall_time FROM usage GROUP BY mode"


def g3_usage_extended(d: Spark) -> str:
    source = "CASE WHEN cached THEN tokens ELSE cast(0 AS double) END"
    return f"{_with(d, v.usage(d))} SELECT mode, round(avg(tokens), 4) AS avg_tokens, round(avg({source}), 4) AS avg_source_tokens, round(avg(tokens + {source}), 4) AS avg_end_to_end_tokens, round(avg(wall_time), 4) AS avg_wall_time FROM usage GROUP BY mode"


def p2_usage_state(d: Spark) -> str:
    """What the per-case accumulator holds at the end of each case."""
    return f"{_with(d, v.usage(d))} SELECT qid, cast(count(*) AS bigint) AS calls, round(sum(tokens), 4) AS tokens, round(sum(wall_time), 4) AS wall_time FROM usage GROUP BY qid"


def o3_rescore(d: Spark) -> str:
    """Scores recomputed from texts that differ from the saved ones at four decimals."""
    return f"""{_with(d, v.pairs(d))}, kept AS (SELECT qid, {t.tokens(d, "pred")} AS p, {t.tokens(d, "gold")} AS g, {t.exact(d, "pred", "gold")} AS em FROM pairs),
  scored AS (SELECT qid, cast(em AS double) AS em, {t.f1(d, "p", "g")} AS f1, round(cast(em AS double) * 0.5 + cast(qid % 2 AS double) / 2, 4) AS saved FROM kept)
  SELECT qid, em, f1, saved FROM scored WHERE round(em, 4) <> round(saved, 4) OR f1 > 1"""


def o4_claims(d: Spark) -> str:
    """Expected and observed tables joined; a claim that differs at four decimals is reported."""
    return f"""{_with(d, v.audit(d))}, observed AS (SELECT state AS claim, round(avg(em), 4) AS value FROM audit GROUP BY state),
  expected AS (SELECT 'repaired_complete' AS claim, cast(0.85 AS double) AS value UNION ALL SELECT 'verified_complete', cast(0.85 AS double) UNION ALL SELECT 'no_such_state', cast(1 AS double))
  SELECT coalesce(e.claim, o.claim) AS claim, e.value AS expected, o.value AS observed, coalesce(round(e.value, 4) = o.value, false) AS holds FROM expected e FULL OUTER JOIN observed o ON e.claim = o.claim"""


def d13_queues(d: Spark) -> str:
    return f"""{_with(d, v.audit(d))} SELECT qid, CASE WHEN NOT selected AND NOT complete THEN 'reject' WHEN residual THEN 'residual' WHEN unrepaired THEN 'unrepaired' WHEN selected AND NOT complete THEN 'selected_incomplete' ELSE 'pass' END AS queue FROM audit"""


QUERIES = (g10_risk_bins, k5_audit_rows, g8_audit_states, g8_overview, g9_label_consistency, g11_auc, g12_triage, e10_prefixes, g13_conditional, g14_grouped, g15_proxies, g16_wilson, g17_newcombe, g6_mcnemar, g5_bootstrap, g20_majority, g19_agreement, g18_kappa, g24_transitions, g26_histogram, g29_contrast, g1_run_summary, g2_usage, g3_usage_extended, p2_usage_state, o3_rescore, o4_claims, d13_queues)
