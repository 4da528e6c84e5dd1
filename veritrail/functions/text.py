"""Text kernel: answer normalization, keys, exact match, token F1 and answer predicates.

Each function takes a dialect and column expressions and returns an expression.
Null counts as the empty text throughout.
"""

from __future__ import annotations

from veritrail.functions.dialect import Spark

PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Characters and words that rules name.
EDGES = " \"'`.,:;!?"
BAD_EVALUATION = (
    "cannot", "can not", "no information", "no relevant", "not enough", "cannot determine", "unknown", "insufficient", "not specified", "not stated",
    "not mentioned", "not provided", "no info", "none of the provided", "shortest exact answer phrase", "draft answer", "passage [", "instruction",
    "instructions", "format demands", "per instructions", "provided context", "context does not",
)
BAD_PIPELINE = (
    "cannot", "cannot answer", "cannot determine", "given the constraints", "insufficient", "neither", "no triple", "no triples", "not enough", "no info",
    "no information", "no such", "none", "none of the provided context", "not specified", "not mentioned", "not provided", "not stated", "not in passages",
    "shortest exact answer phrase", "unknown", "let's search again", "let’s search again", "search again", "looking again", "re-read", "reread",
    "not determinable", "wait", "step ", "wait:", "but wait", "but note", "therefore,", "the question", "question demands", "but the", "also:", "re:",
    "passage", "draft answer", "instruction", "instructions", "final answer", "final answ", "未提及", "无法确定", "不能确定", "implying", "is phrased",
    "the only team matching", "originally located at an",
)
BAD_DUAL = (
    "unknown", "cannot", "can not", "insufficient", "not enough", "no information", "not specified", "provided context", "context does not", "triple",
    "triples", "instruction", "instructions", "graph does not", "given the constraints",
)
DANGLING = ("the", "a", "an", "of", "by", "to", "is", "was", "and", "or", "in")
YESNO_STARTS = ("are ", "is ", "was ", "were ", "do ", "does ", "did ", "has ", "have ", "had ", "can ", "could ", "will ", "would ")


def tidy(d: Spark, x: str) -> str:
    """White space once, none at the ends."""
    return f"trim({d.rep(x, r'[ \t\n\r\f\x0b]+', ' ')})"


#: White space between words.
WHITE = r"[ \t\n\r\f\x0b]+"


def words(d: Spark, x: str) -> str:
    return d.filter(d.split(x, WHITE), "w", "w <> ''")


def first_words(d: Spark, x: str, n: int) -> str:
    """The first n words; Spark splits no further than these."""
    found = f"split({x}, {d.lit(WHITE)}, {n + 2})" if d.name == "spark" else d.split(x, WHITE)
    return d.slice(d.filter(found, "w", "w <> ''"), "1", str(n))


def last_word(d: Spark, x: str) -> str:
    """The last word, null without one; Spark searches from the end."""
    if d.name != "spark":
        return d.at(words(d, x), -1)
    return f"nullif(substring_index(rtrim(translate({x}, '\\t\\n\\r\u000c\u000b', '     ')), ' ', -1), '')"


def n_words(d: Spark, x: str) -> str:
    return d.size(words(d, x))


def normalized(d: Spark, x: str) -> str:
    """Lower case, articles as spaces, then punctuation deleted, then white space once; the order matters."""
    return tidy(d, d.rep(d.articles(f"lower(coalesce({x}, ''))"), PUNCTUATION))


def tokens(d: Spark, x: str) -> str:
    return d.filter(d.split(normalized(d, x), " "), "w", "w <> ''")


def sorted_key(d: Spark, x: str) -> str:
    """The set of tokens, sorted, as one text."""
    return d.joined(d.sorted(d.distinct(tokens(d, x))), " ")


def entity_name(d: Spark, x: str) -> str:
    """Lower case, no punctuation, without one leading article."""
    bare = d.rep(f"lower(coalesce({x}, ''))", r"[^\p{L}\p{N}_\s]")
    return tidy(d, d.rep(bare, r"^(the |a |an )"))


def entity_key(d: Spark, x: str) -> str:
    """Lower case, punctuation as spaces; articles stay."""
    return tidy(d, d.rep(f"lower(coalesce({x}, ''))", r"[^\p{L}\p{N}_\s]", " "))


def surface_key(d: Spark, x: str) -> str:
    return f"trim({d.rep(f"lower(coalesce({x}, ''))", '[^a-z0-9]+', ' ')})"


def edged(d: Spark, x: str, edges: str = EDGES) -> str:
    """x without the characters of edges at both ends."""
    inside = edges.replace("\\", "\\\\").replace("]", r"\]").replace("[", r"\[").replace("-", r"\-")
    return d.rep(x, f"^[{inside}]+|[{inside}]+$")


def compact(d: Spark, x: str) -> str:
    """Lower case without quotes and stops at the ends, white space once."""
    return tidy(d, f"lower({edged(d, f"trim(coalesce({x}, ''))", EDGES[1:])})")


def unmarked(d: Spark, x: str) -> str:
    """x without data citations and markup."""
    no_data = d.rep(f"coalesce({x}, '')", r"(?i)\[data:[^\]]*\]")
    return tidy(d, d.rep(d.rep(no_data, r"\[([^\]]*)\]\([^)]+\)", r"\1"), "[*_#>`]", " "))


def has_any(d: Spark, x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {d.lit(m)})" for m in markers) + ")"


def starts_any(d: Spark, x: str, heads) -> str:
    return "(" + " OR ".join(d.starts(x, d.lit(h)) for h in heads) + ")"


def one_of(d: Spark, x: str, values) -> str:
    return f"{x} IN ({', '.join(d.lit(v) for v in values)})"


def bad_evaluation(d: Spark, x: str) -> str:
    low = f"trim(lower(coalesce({x}, '')))"
    return f"({low} = '' OR {has_any(d, low, BAD_EVALUATION)})"


def bad_pipeline(d: Spark, x: str) -> str:
    low = tidy(d, f"lower(coalesce({x}, ''))")
    last = d.at(d.split(low, " "), -1)
    heads = ("-", "check:", "however,", "but the instruction", "only ", "all other named")
    return f"({low} = '' OR {has_any(d, low, BAD_PIPELINE)} OR {one_of(d, last, DANGLING)} OR {starts_any(d, low, heads)} OR contains({low}, '-->') OR contains(lower({x}), ' -- ') OR ({d.starts(low, "'and '")} AND {n_words(d, low)} > 8))"


def bad_dual(d: Spark, x: str) -> str:
    low = f"trim(lower(coalesce({x}, '')))"
    return f"(length({low}) < 2 OR {has_any(d, low, BAD_DUAL)} OR {n_words(d, low)} > 20 OR {starts_any(d, low, ('however,', 'but the', 'check:', '-'))})"


def exact(d: Spark, pred: str, gold: str) -> str:
    return f"CASE WHEN {normalized(d, pred)} = {normalized(d, gold)} THEN 1 ELSE 0 END"


def overlap(d: Spark, a: str, b: str) -> str:
    """Size of the common multiset of two arrays."""
    count = lambda array, v: d.size(d.filter(array, v, f"{v} = k"))
    return d.total(d.transform(d.distinct(a), "k", f"least({count(a, 'p')}, {count(b, 'q')})"))


def f1(d: Spark, pred: str, gold: str, both_empty: float = 0.0) -> str:
    """Token F1 of two arrays of tokens; both_empty is its value for two empty ones."""
    both = f"({d.size(pred)} + {d.size(gold)})"
    return f"CASE WHEN {both} = 0 THEN cast({both_empty} AS double) ELSE round(2 * cast({overlap(d, pred, gold)} AS double) / {both}, 4) END"


def subset(d: Spark, a: str, b: str) -> str:
    """Whether every element of a is in b."""
    return f"({d.size(d.filter(a, 'e', f'NOT {d.holds(b, "e")}'))} = 0)"


def balanced(d: Spark, x: str) -> str:
    n = lambda c: f"(length({x}) - length(replace({x}, '{c}', '')))"
    return f"({n('(')} = {n(')')} AND {n('[')} = {n(']')})"


def contains_token_share(d: Spark, a: str, b: str) -> str:
    """The share of a's distinct tokens that b has, 0 for none."""
    return f"CASE WHEN {d.size(a)} = 0 THEN cast(0 AS double) ELSE cast({d.size(d.common(a, b))} AS double) / {d.size(d.distinct(a))} END"
