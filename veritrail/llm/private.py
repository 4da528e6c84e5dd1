"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base patterns find e-mail and IP addresses, card and phone numbers, whose spans always
stay. Generators with high recall propose further, overlapping spans of five kinds (masked
addresses, numbers in any grouping, secrets: runs of letters and digits); format and
context of each candidate are bits. Boosted trees learn from examples that are made by
rule (EXAMPLES of them, a parameter): each puts one form of FORMS, masked or spaced
personal data or something that only looks like it, between plain words, and goes
through the same generators and features as any text. So labels don't come from the base
patterns. Trees are grown on counts of examples by bits and become one SQL expression.
Scores are calibrated for each kind on examples that the trees haven't seen: a candidate
is taken from the lowest score on at which the share of true ones is at least PRECISION
(its lower 95 % bound). Candidates that meet a base span are dropped: they are found.

Spans are start and end in code points, end exclusive. Patterns that begin with a run
of characters look at the character before, so that no run is tried from its middle: a
long text takes time in proportion to its length.

Defined results: null or empty texts have no spans; a base match that fails its test is
dropped and not tried shorter; equal spans of one kind are one; repeated rows are read
each for itself; an empty table gives no rows; a null doc_id stays null; other columns
are not read (redacted() keeps doc_id and text).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: A match begins where no run of its first class is cut: after another character, or where the last match ended.
BASE = {
    "email": f"(?:(?<!{_LOCAL})|\\\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\\\G)[0-9]++(?:\\\\.[0-9]++){3}",
    "card": "[0-9]++(?:[\\\\x20-][0-9]++)*+",
    "phone": "\\\\+[0-9][\\\\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "digits", "card": "digits", "phone": "instr(text, '+') > 0"}
_MASKED = "(?:\\\\(\\\\.\\\\)|\\\\[\\\\.\\\\]|\\\\(dot\\\\)|\\\\[dot\\\\])"
_DOT = f"(?:\\\\.|\\\\x20\\\\.\\\\x20|\\\\x20?{_MASKED}\\\\x20?)"
_KEY = "[A-Za-z0-9+/_-]"
#: How keys of common services begin.
_PREFIX = "(?:AKIA|ASIA|AIza|gh[opsu]_|sk[-_]|xox[abp]-|eyJ)"
GENERATORS = {
    "email": f"(?:(?<!{_LOCAL})|\\\\G){_LOCAL}{{1,64}}+\\\\x20?(?:@|\\\\(at\\\\)|\\\\[at\\\\])\\\\x20?[A-Za-z0-9-]{{1,64}}+(?:{_DOT}[A-Za-z0-9-]{{1,64}}+){{1,8}}+",
    "ip": f"(?:(?<![0-9])|\\\\G)[0-9]++(?:(?:{_DOT}|,\\\\x20?)[0-9]++){{3}}",
    "card": "(?:(?<![0-9])|\\\\G)[0-9]{4}+(?:[\\\\x20./_-]{0,2}+[0-9]){8,15}+(?![0-9])",
    "phone": "(?:(?<![0-9+(])|\\\\G)[+(]?[0-9](?:[\\\\x20()./-]{0,2}+[0-9]){7,14}+(?![0-9])",
    # A run of letters and digits, with one of either, or one that begins as a service's key.
    "secret": f"(?:(?<!{_KEY})|\\\\G)(?={_KEY}*[A-Za-z])(?={_KEY}*[0-9]|{_PREFIX}{_KEY}{{12}}){_KEY}{{8,}}+",
}
GENERATED_NEEDS = {"email": "(instr(text, '@') > 0 OR instr(text, '(at)') > 0 OR instr(text, '[at]') > 0)", "ip": "digits", "card": "digits", "phone": "digits", "secret": f"(digits OR text rlike '{_PREFIX}{_KEY}{{12}}')"}

_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substr(d, length(d) - i + 1, 1) AS int) "
    "ELSE CASE WHEN substr(d, length(d) - i + 1, 1) >= '5' THEN 2 * cast(substr(d, length(d) - i + 1, 1) AS int) - 9 ELSE 2 * cast(substr(d, length(d) - i + 1, 1) AS int) END END) % 10 = 0"
)


def _octets(m: str) -> str:
    return f"forall(transform(split(replace({m}, ' ', ''), '[.,]'), p -> regexp_replace(p, '^0+(?=.)', '')), p -> length(p) <= 3 AND cast(substr(p, 1, 3) AS int) <= 255)"


def _digits(m: str, test: str) -> str:
    """test with d for the digits of m, found once."""
    return f"exists(array(regexp_replace({m}, '[^0-9]', '')), d -> {test})"


VALID = {
    "email": "true",
    "ip": _octets("x.m"),
    "card": _digits("x.m", f"length(d) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": _digits("x.m", "length(d) BETWEEN 8 AND 15"),
}
#: Bits of a candidate c: c.m is what it holds, c.b what stands before it, c.a what stands after it.
FEATURES = {
    "kind_email": "c.kind = 1",
    "kind_ip": "c.kind = 2",
    "kind_card": "c.kind = 3",
    "kind_phone": "c.kind = 4",
    "plus": "instr(c.m, '+') > 0",
    "bracket": "instr(c.m, '(') > 0 OR instr(c.m, '[') > 0",
    "space": "instr(c.m, ' ') > 0",
    "dot": "instr(c.m, '.') > 0",
    "comma": "instr(c.m, ',') > 0",
    "dot_space": "c.m rlike '[.,] '",
    "groups": "c.m rlike '^[^0-9]?[0-9]{3,4}[^0-9]{1,2}[0-9]{3}[^0-9]{1,2}[0-9]{4}$'",
    "fours": "c.m rlike '^[0-9]{4}([^0-9]{1,2}[0-9]{4}){2,3}$'",
    "date": "c.m rlike '(^|[^0-9])((19|20)[0-9]{2}[-/. ]?(0[1-9]|1[0-2])|(19|20)[0-9]{2}[-/](19|20)[0-9]{2})'",
    "many_digits": _digits("c.m", "length(d) >= 16"),
    "some_digits": _digits("c.m", "length(d) BETWEEN 10 AND 15"),
    "luhn": f"c.kind = 3 AND {_digits('c.m', _LUHN)}",
    "octets": "c.kind = 2 AND c.m rlike '^[^0-9]*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])([^0-9]+(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$'",
    "named": "c.b rlike '(?i)(mail|phone|tel|call|fax|mobile|contact|card|carte|tarjeta|karte|ip|host|server)[^A-Za-z]*$'",
    "keyed": "c.b rlike '(?i)(pass|passwords?|passwd|pwd|secrets?|tokens?|keys?|auth|bearer|credentials?)[^A-Za-z0-9]{1,5}$'",
    "hashed": "c.b rlike '(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|revision|uuid|isbn|version|order|file)[^A-Za-z0-9]{1,5}$'",
    "joined": "c.b rlike '[A-Za-z0-9_.,/-]$' OR c.a rlike '^[A-Za-z0-9_/-]'",
    "prefix": f"c.m rlike '^{_PREFIX}[A-Za-z0-9_-]{{12,}}$'",
    "hex": "c.m rlike '^([0-9a-f]+|[0-9A-F]+)$'",
    "long": "length(c.m) >= 16",
    "uuid": "c.m rlike '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4,12})+$'",
    "slug": "c.m rlike '^([a-z]+|[0-9]+)([-_/]([a-z]+|[0-9]+))+$'",
    "mixed": "c.m rlike '[a-z]' AND c.m rlike '[A-Z]'",
}
EXAMPLES = 12_000
ROUNDS, DEPTH, RATE, MIN_CHILD = 40, 3, 0.4, 5.0
PRECISION = 0.95

_HEX = "sha2(cast(id AS string), 256)"
_ALNUM = "translate(base64(unhex(sha2(cast(id AS string), 256))), '+/=', 'xY')"
_NAME, _HOST, _TLD = "element_at(words, 1 + cast(id % 5 AS int))", "element_at(words, 6 + cast(id % 3 AS int))", "element_at(array('com', 'org', 'net', 'example'), 1 + cast(id % 4 AS int))"


def _n(k: int, digits: int) -> str:
    """A number of so many digits; k tells the example's numbers apart."""
    return f"lpad(cast(pmod(xxhash64(id, {k}), {10**digits}) AS string), {digits}, '0')"


def _octet(k: int) -> str:
    return f"cast(pmod(xxhash64(id, {k}), 256) AS string)"


def _four(sep: str, number: str) -> str:
    return f"concat_ws('{sep}', substr({number}, 1, 4), substr({number}, 5, 4), substr({number}, 9, 4), substr({number}, 13, 4))"


#: What an example holds: its kind (0: nothing personal), what stands before it, and the thing itself.
FORMS = (
    *((1, b, f"concat({_NAME}, '{at}', {_HOST}, '{dot}', {_TLD})") for b in ("''", "'mail: '") for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."))),
    (0, "''", f"concat({_NAME}, ' @ ', {_HOST}, '. ', initcap({_NAME}))"), (0, "'seen '", f"concat({_NAME}, '@', {_HOST}, ' . ', {_NAME})"), (0, "'seen '", f"concat({_NAME}, ' (at) ', {_HOST}, '. ', {_HOST})"),
    *((2, b, f"concat_ws('{dot}', {_octet(1)}, {_octet(2)}, {_octet(3)}, {_octet(4)})") for b in ("''", "'host '") for dot in ("[.]", "(dot)", " . ", "[dot]")),
    (0, "''", f"concat_ws(', ', {_octet(1)}, {_octet(2)}, {_octet(3)}, {_octet(4)})"), (0, "''", f"concat_ws(',', {_n(1, 2)}, {_n(2, 3)}, {_n(3, 3)}, {_n(4, 3)})"), (0, "'version '", f"concat_ws('.', {_n(1, 1)}, {_n(2, 2)}, {_n(3, 4)}, {_n(4, 1)})"),
    (0, "''", f"concat_ws('. ', {_octet(1)}, {_octet(2)}, {_octet(3)}, {_octet(4)})"), (0, "''", f"concat('9', {_n(1, 3)}, '.', {_n(2, 1)}, '.', {_n(3, 1)}, '.', {_n(4, 1)})"),
    *((3, b, _four(sep, "card")) for b in ("''", "'card '") for sep in (".", "/", "_", "  ")),
    (0, "''", "no_card"), (0, "'order '", "no_card"), *((0, "''", _four(sep, "no_card")) for sep in ("", ".", "-", " ", "  ")), (0, "''", f"concat({_n(1, 9)}, {_n(2, 9)}, {_n(3, 9)})"),
    *((4, b, f"concat({x})") for b in ("''", "'call '") for x in (f"'(', {_n(1, 3)}, ') ', {_n(2, 3)}, '-', {_n(3, 4)}", f"{_n(1, 3)}, '-', {_n(2, 3)}, '-', {_n(3, 4)}", f"{_n(1, 3)}, '.', {_n(2, 3)}, '.', {_n(3, 4)}")),
    (4, "'tel: '", f"concat('00', {_n(1, 2)}, ' ', {_n(2, 2)}, ' ', {_n(3, 7)})"), (4, "'phone '", _n(1, 10)), (4, "'fax '", f"concat('0', {_n(1, 3)}, '/', {_n(2, 7)})"),
    (0, "''", f"concat('20', {_n(1, 2)}, '-0', 1 + id % 9, '-1', {_n(2, 1)}, ' 1', {_n(3, 1)}, '.', {_n(4, 2)})"), (0, "''", f"concat('19', {_n(1, 2)}, '-20', {_n(2, 2)})"), (0, "'isbn '", f"concat('978-', {_n(1, 1)}, '-', {_n(2, 2)}, '-', {_n(3, 6)}, '-', {_n(4, 1)})"),
    (0, "''", _n(1, 8)), (0, "''", _n(1, 12)), (0, "'order '", _n(1, 10)), (0, "''", f"concat({_n(1, 1)}, '.', {_n(2, 9)})"), (0, "''", f"concat({_n(1, 2)}, '.', {_n(2, 3)}, '.', {_n(3, 3)})"), (0, "''", f"concat({_n(1, 4)}, ' ', {_n(2, 4)}, ' ', {_n(3, 2)})"),
    *((5, b, x) for b in ("'password='", "'token = \"'", "'secret: '", "'api_key='", "'Bearer '", "'pwd: '") for x in (f"substr({_HEX}, 1, 40)", f"substr({_HEX}, 3, 18)", f"substr({_ALNUM}, 1, 32)", f"concat('x7', substr({_ALNUM}, 1, 10))")),
    *((5, b, f"concat('{p}', substr({x}, 1, {n}))") for b in ("''", "'key '") for p, x, n in (("AKIA", f"upper({_ALNUM})", 16), ("ghp_", _ALNUM, 36), ("sk-", _ALNUM, 40), ("xoxb-", _ALNUM, 24))),
    *((0, b, f"substr({_HEX}, 1, 40)") for b in ("''", "'commit '", "'sha1: '", "'checksum='")), *((0, b, f"substr({_HEX}, 1, 32)") for b in ("''", "'md5 '")),
    (0, "''", f"concat(substr({_HEX}, 1, 8), '-', substr({_HEX}, 9, 4), '-', substr({_HEX}, 13, 4), '-', substr({_HEX}, 17, 12))"), (0, "'file '", f"concat({_NAME}, '_', {_HOST}, '_', {_n(1, 4)})"), (0, "''", f"concat({_NAME}, {_n(1, 6)})"),
    (0, "''", f"concat({_NAME}, '/', {_HOST}, '-', {_n(1, 2)})"), (0, "''", f"concat({_HOST}, '-', {_n(1, 2)}, '-', {_NAME})"), (0, "''", f"substr({_ALNUM}, 1, 12)"),
)
PLAIN_WORDS = ("winter", "house", "maria", "river", "stone", "garden", "bridge", "paper", "evening", "of", "the", "and")


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """doc_id and text of made examples, and what each holds: kind (0: nothing personal), s and e."""
    words = ", ".join(f"'{w}'" for w in PLAIN_WORDS)
    rows = spark.range(0, n, 1, 4).selectExpr("id", f"id % {len(FORMS)} AS form", f"sort_array(transform(array({words}), w -> struct(xxhash64(id, w) AS h, w))).w AS words", f"concat('4', {_n(5, 7)}, {_n(6, 7)}) AS stem")
    checked = f"filter(sequence(0, 9), x -> exists(array(concat(stem, x)), d -> {_LUHN}))[0]"
    rows = rows.selectExpr("id", "form", "words", "stem", f"{checked} AS digit").selectExpr("id", "form", "words", "concat(stem, digit) AS card", "concat(stem, (digit + 1 + id % 9) % 10) AS no_card")
    of = lambda j: "CASE form " + " ".join(f"WHEN {i} THEN {f[j]}" for i, f in enumerate(FORMS)) + " END"
    rows = rows.selectExpr("id", "words", f"{of(0)} AS kind", f"{of(1)} AS before", f"{of(2)} AS thing")
    rows = rows.selectExpr("id", "kind", "concat(array_join(slice(words, 1, 6), ' '), ' ', before) AS before", "thing", "concat(element_at(array(' ', '. ', ', ', '\" '), 1 + cast(pmod(xxhash64(id, 9), 4) AS int)), array_join(slice(words, 7, 6), ' ')) AS after")
    return rows.selectExpr("id AS doc_id", "concat(before, thing, after) AS text", "kind", "length(before) AS s", "length(before) + length(thing) AS e")


def _found(pattern: str, needs: str, kind: int) -> str:
    """All matches: an array of kind, start, end, text and what stands before and after, by the lengths of what split() leaves between.

    Places are added up within blocks of 256 matches, then over blocks, so that time doesn't grow with the square of their number.
    """
    none = "cast(array() AS array<struct<kind: int, s: int, e: int, m: string, b: string, a: string>>)"
    pairs = f"transform(array(split(text, '{pattern}', -1)), gaps -> filter(arrays_zip(gaps, regexp_extract_all(text, '{pattern}', 0), slice(gaps, 2, size(gaps))), x -> x.`1` IS NOT NULL))[0]"
    begin, end = "s.at + length(x.gaps)", "s.at + length(x.gaps) + length(x.`1`)"
    one = f"named_struct('kind', {kind}, 's', {begin}, 'e', {end}, 'm', x.`1`, 'b', right(x.gaps, 24), 'a', left(x.`2`, 4))"
    blocks = f"transform(sequence(0, cast((size(p) - 1) div 256 AS int)), k -> aggregate(slice(p, 1 + 256 * k, 256), named_struct('at', 0, 'all', {none}), (s, x) -> named_struct('at', {end}, 'all', concat(s.all, array({one})))))"
    starts = "aggregate(blocks, named_struct('at', 0, 'all', cast(array() AS array<int>)), (s, x) -> named_struct('at', s.at + x.at, 'all', concat(s.all, array(s.at))), s -> s.all)"
    moved = "named_struct('kind', y.kind, 's', y.s + at, 'e', y.e + at, 'm', y.m, 'b', y.b, 'a', y.a)"
    listed = f"transform(array({pairs}), p -> transform(array({blocks}), blocks -> flatten(zip_with(blocks, {starts}, (x, at) -> transform(x.all, y -> {moved}))))[0])[0]"
    return f"CASE WHEN {needs} AND text rlike '{pattern}' THEN {listed} ELSE {none} END"


def _case(tree: dict) -> str:
    if "value" in tree:
        return f"{tree['value']:.6f}D"
    return f"(CASE WHEN bits & {1 << tree['bit']} <> 0 THEN {_case(tree['yes'])} ELSE {_case(tree['no'])} END)"


class Boosted:
    """Trees grown on counts of candidates by their bits: rows of (bits, confirmed, all)."""

    def __init__(self, rows: list[tuple[int, float, float]], features: int = len(FEATURES)):
        total, good = sum(r[2] for r in rows), sum(r[1] for r in rows)
        self.prior = math.log((good + 1) / (total - good + 1))
        self.trees: list[dict] = []
        margins = [self.prior] * len(rows)
        for _ in range(ROUNDS if rows else 0):
            chances = [1 / (1 + math.exp(-m)) for m in margins]
            g = [r[1] - p * r[2] for r, p in zip(rows, chances, strict=True)]
            h = [p * (1 - p) * r[2] for r, p in zip(rows, chances, strict=True)]
            tree = self._grown(rows, g, h, list(range(len(rows))), DEPTH, features)
            self.trees.append(tree)
            margins = [m + self._leaf(tree, r[0]) for m, r in zip(margins, rows, strict=True)]

    def _grown(self, rows, g, h, here, depth, features) -> dict:
        value = lambda at: sum(g[i] for i in at) / (sum(h[i] for i in at) + 1.0)
        gain = lambda at: sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + 1.0)
        best = (1e-6, None)
        for bit in range(features if depth else 0):
            yes = [i for i in here if rows[i][0] >> bit & 1]
            no = [i for i in here if not rows[i][0] >> bit & 1]
            if min(sum(rows[i][2] for i in yes), sum(rows[i][2] for i in no)) >= MIN_CHILD:
                best = max(best, (gain(yes) + gain(no) - gain(here), (bit, yes, no)), key=lambda b: b[0])
        if best[1] is None:
            return {"value": RATE * value(here)}
        bit, yes, no = best[1]
        return {"bit": bit, "yes": self._grown(rows, g, h, yes, depth - 1, features), "no": self._grown(rows, g, h, no, depth - 1, features)}

    def _leaf(self, tree: dict, bits: int) -> float:
        while "bit" in tree:
            tree = tree["yes"] if bits >> tree["bit"] & 1 else tree["no"]
        return tree["value"]

    def margin(self, bits: int) -> float:
        return self.prior + sum(self._leaf(t, bits) for t in self.trees)

    def sql(self) -> str:
        return " + ".join([f"{self.prior:.6f}D", *map(_case, self.trees)])


def calibrated(model: Boosted, rows: list[tuple[int, float, float]], precision: float = PRECISION) -> float | None:
    """The lowest margin from which on candidates are confirmed often enough; None if there is none."""
    best, good, total = None, 0.0, 0.0
    scored = sorted(((round(model.margin(b), 6), c, n) for b, c, n in rows), reverse=True)
    for i, (margin, confirmed, n) in enumerate(scored):
        good, total = good + confirmed, total + n
        if i + 1 < len(scored) and scored[i + 1][0] == margin:
            continue
        share, z = good / total, 1.645
        low = (share + z * z / (2 * total) - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)
        if low >= precision:
            best = margin
    return best


#: Whether a candidate x meets the last base span that begins before its end: sorted has base spans by start.
_MET = (
    "exists(array(aggregate(sequence(0, cast(log2(1 + size(sorted)) AS int)), named_struct('lo', 0, 'hi', size(sorted)), (w, i) -> CASE WHEN w.lo >= w.hi THEN w "
    "WHEN sorted[cast((w.lo + w.hi) div 2 AS int)].s < x.e THEN named_struct('lo', cast((w.lo + w.hi) div 2 AS int) + 1, 'hi', w.hi) "
    "ELSE named_struct('lo', w.lo, 'hi', cast((w.lo + w.hi) div 2 AS int)) END, w -> w.lo)), n -> n > 0 AND sorted[n - 1].e > x.s)"
)


def candidates(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, base (valid spans of base patterns), more (span and bits of each candidate that meets none of them) and the columns kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    rows = rows.selectExpr("*", "text rlike '[0-9]' AS digits")
    base = [f"filter({_found(BASE[k], NEEDS[k], i)}, x -> {VALID[k]})" for i, k in enumerate(KINDS, 1)]
    proposed = [_found(GENERATORS[k], GENERATED_NEEDS[k], i) for i, k in enumerate(ALL_KINDS, 1)]
    rows = rows.selectExpr("doc_id", *kept, f"inline(array(struct(transform(concat({', '.join(base)}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)) AS base, concat({', '.join(proposed)}) AS proposed)))")
    rows = rows.selectExpr("doc_id", *kept, "base", "proposed", "inline(array(struct(array_sort(transform(base, x -> named_struct('s', x.s, 'e', x.e))) AS sorted)))")
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, test in enumerate(FEATURES.values()))
    return rows.selectExpr("doc_id", *kept, "base", f"transform(filter(proposed, x -> NOT {_MET}), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'bits', {bits})) AS more")


def learned(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> tuple[Boosted, dict[int, float]]:
    """Trees that learned from made examples, and for each kind the least margin at which a candidate is taken (no entry: none is)."""
    rows = candidates(examples(spark, n), "kind", "s", "e")
    each = rows.selectExpr("crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 0 AS fit", "kind AS of", "s AS begin", "e AS until", "inline(more)")
    # A candidate is true if it is of the example's kind and holds the thing, give or take a mark at its ends.
    true = "CASE WHEN kind = of AND abs(s - begin) <= 1 AND abs(e - until) <= 1 THEN 1D ELSE 0D END"
    # At most a row for each example and candidate comes to the driver: their number is a parameter.
    counted = each.selectExpr("fit", "kind", "bits", f"{true} AS good").groupBy("fit", "kind", "bits").agg(F.sum("good").alias("good"), F.count("*").cast("double").alias("n")).collect()
    of = lambda fit, kind: sorted((r["bits"], r["good"], r["n"]) for r in counted if bool(r["fit"]) == fit and kind in (0, r["kind"]))
    model = Boosted(of(True, 0))
    least = {i: calibrated(model, of(False, i), precision) for i in range(1, len(ALL_KINDS) + 1)}
    return model, {i: x for i, x in least.items() if x is not None}


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of kind (1 to 5), start and end; spans has base and what the trees add."""
    model, least = learned(docs.sparkSession)
    taken = "CASE c.kind " + " ".join(f"WHEN {i} THEN margin >= {x:.6f}D" for i, x in sorted(least.items())) + " ELSE false END" if least else "false"
    added = f"transform(filter(more, c -> exists(array(c.bits), bits -> exists(array(round({model.sql()}, 6)), margin -> {taken}))), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))"
    # inline() holds the candidates: each is found once.
    rows = candidates(docs).selectExpr("doc_id", "inline(array(struct(base, more)))")
    return rows.selectExpr("doc_id", "array_sort(array_distinct(base)) AS base", f"array_sort(array_distinct(concat(base, {added}))) AS spans")


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind - 1], x.s, x.e)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, and how many spans there are in all (n_spans) and of secrets (n_secret)."""
    counts = [f"cast(size(filter(base, x -> x.kind = {i})) AS bigint) AS n_{k}" for i, k in enumerate(KINDS, 1)]
    more = ["cast(size(spans) AS bigint) AS n_spans", f"cast(size(filter(spans, x -> x.kind = {len(ALL_KINDS)})) AS bigint) AS n_secret"]
    rows = found(docs).selectExpr("doc_id", "inline(array(struct(base, spans)))")
    return rows.selectExpr("doc_id", *counts, f"sha2({_listed('base')}, 256) AS base_sha256", f"{_listed('spans')} AS spans", *more)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span of found() as its kind in brackets; overlapping spans are one, named by the first."""
    spans = found(docs).selectExpr("doc_id AS of", "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, F.col("doc_id") == F.col("of"), "left")
    names = ", ".join(f"'[{k}]'" for k in ALL_KINDS)
    by_place = "array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    step = f"CASE WHEN x.s >= s.at THEN named_struct('at', x.e, 'out', concat(s.out, substr(text, s.at + 1, x.s - s.at), array({names})[x.kind - 1])) ELSE named_struct('at', greatest(s.at, x.e), 'out', s.out) END"
    out = f"aggregate({by_place}, named_struct('at', 0, 'out', ''), (s, x) -> {step}, s -> concat(s.out, substr(text, s.at + 1)))"
    return rows.selectExpr("doc_id", f"CASE WHEN text IS NULL OR spans IS NULL OR size(spans) = 0 THEN text ELSE {out} END AS text")
