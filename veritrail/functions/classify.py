"""Ordered case-when classifiers: question and answer types, audit states and risk."""

from __future__ import annotations

from veritrail.functions import text as t
from veritrail.functions.dialect import Spark

#: Surface forms that decide a type.
COMPARISON_FORMS = ("which film is newer", "which film is older", "which is newer", "which is older", "who was born first", "who was born earlier", "who was born later", "released first", "came first")
COMPARISON_WORDS = ("older", "younger", "first", "earlier", "later", "more ", "larger", "bigger", "smaller", "closer", "nearer", "further", "released first", "came first", "born first")
LOCATION_FORMS = ("what city", "what country", "what state", "what region", "located in", "headquartered in", "based in")
NUMBER_FORMS = ("how many", "what year", "when was", "when did", "what date", "what age", "population", "number of")
PERSON_FORMS = ("which person", "which actor", "which actress", "which author", "which composer", "which player")
AWARD_WORDS = ("award", "prize", "egot", "oscar", "emmy", "grammy", "tony", "academy", "golden globe", "pulitzer")
PROFESSION_WORDS = ("actor", "artist", "author", "composer", "director", "musician", "pianist", "player", "politician", "professor", "singer", "writer", "wrestler", "journalist", "footballer", "coach")
PLACE_WORDS = ("city", "county", "state", "province", "district", "kingdom", "republic", "usa", "united states", "new york", "london")
COUNTRY_WORDS = ("country", "kingdom", "republic", "united states", "usa", "uk", "british", "american", "canada", "china", "france", "germany", "india", "japan", "russia", "yemen")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
GENERIC_ENTITIES = ("american", "british", "president", "general", "film", "films", "city", "country", "location", "profession", "award")
RESIDUAL_GAPS = ("short_chain", "disconnected", "empty_evidence")
OPEN_TYPES = ("entity", "yesno", "choice", "comparison")


def answer_type(d: Spark, q: str) -> str:
    """One of twelve classes of the answer a question asks for."""
    q = f"trim(lower(coalesce({q}, '')))"
    yesno = t.starts_any(d, q, t.YESNO_STARTS)
    has = lambda *m: t.has_any(d, q, m)
    return (
        f"CASE WHEN {has(*COMPARISON_FORMS)} THEN 'comparison' WHEN {has(' or ')} AND {yesno} THEN 'choice' WHEN {yesno} THEN 'yesno' "
        f"WHEN {has('award', 'prize')} THEN 'award' WHEN {has('profession', 'occupation', 'job')} THEN 'profession' "
        f"WHEN {d.starts(q, d.lit('where'))} OR {has('what location', 'what city', 'which city', 'located')} THEN 'location' WHEN {has('country')} THEN 'country' "
        f"WHEN {has('what year', 'when ', 'what date', 'which period')} THEN 'date' WHEN {has('which president', 'what president')} THEN 'ordinal' "
        f"WHEN {has('how many', 'population', 'number of')} THEN 'number' WHEN {d.starts(q, d.lit('who '))} OR {has('which person')} THEN 'person' ELSE 'entity' END"
    )


def question_type(d: Spark, q: str) -> str:
    """The seven classes that pick a path."""
    q = f"trim(lower(coalesce({q}, '')))"
    has = lambda m: t.has_any(d, q, m)
    return (
        f"CASE WHEN {t.starts_any(d, q, t.YESNO_STARTS)} THEN 'yesno' WHEN {has(COMPARISON_WORDS)} THEN 'comparison' "
        f"WHEN {d.starts(q, d.lit('where'))} OR {has(LOCATION_FORMS)} THEN 'location' WHEN {has(NUMBER_FORMS)} THEN 'number_date' "
        f"WHEN {d.starts(q, d.lit('who '))} OR {has(PERSON_FORMS)} THEN 'person' WHEN {has((' both ', 'in common'))} THEN 'common' ELSE 'other' END"
    )


def least_edges(d: Spark, q: str) -> str:
    """Edges a chain needs before it may count as complete."""
    return f"CASE WHEN {t.starts_any(d, f"trim(lower(coalesce({q}, '')))", t.YESNO_STARTS)} THEN 1 ELSE 2 END"


def node_fits(d: Spark, node: str, kind: str) -> str:
    """Whether a node's text can be an answer of a type."""
    x = f"lower(coalesce({node}, ''))"
    has = lambda m: t.has_any(d, x, m)
    return (
        f"CASE WHEN {x} = '' THEN false WHEN {t.one_of(d, kind, OPEN_TYPES)} THEN true WHEN {kind} = 'award' THEN {has(AWARD_WORDS)} "
        f"WHEN {kind} = 'profession' THEN {has(PROFESSION_WORDS)} WHEN {kind} = 'location' THEN contains({x}, ',') OR {has(PLACE_WORDS)} "
        f"WHEN {kind} = 'country' THEN {has(COUNTRY_WORDS)} WHEN {kind} = 'date' THEN {d.rlike(x, r'\b(1[5-9][0-9]{2}|20[0-9]{2})\b')} OR {has(MONTHS)} "
        f"WHEN {kind} = 'number' THEN {d.rlike(x, '[0-9]')} WHEN {kind} = 'ordinal' THEN {d.rlike(x, r'\b[0-9]+(st|nd|rd|th)?\b')} "
        f"WHEN {kind} = 'person' THEN {t.n_words(d, x)} >= 2 AND NOT contains({x}, ',') ELSE true END"
    )


def loose_bool(d: Spark, x: str) -> str:
    return f"coalesce(lower(trim(cast({x} AS string))) IN ('1', 'true', 'yes'), false)"


def audit_state(complete: str, repaired: str, fallback: str) -> str:
    return (
        f"CASE WHEN {complete} AND {repaired} THEN 'repaired_complete' WHEN {complete} THEN 'verified_complete' WHEN {fallback} THEN 'fallback_incomplete' "
        f"WHEN {repaired} THEN 'repaired_incomplete' ELSE 'unrepaired_incomplete' END"
    )


def risk_bin(score: str) -> str:
    return f"CASE WHEN {score} >= 4 THEN '4+' ELSE cast({score} AS string) END"
