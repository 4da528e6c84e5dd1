"""SQL expressions for two engines: Spark runs the plans, DuckDB checks them.

Everything below builds text; Catalyst plans it. Methods name what differs between the
engines: literals, lambdas, arrays and regular expressions.
"""

from __future__ import annotations


#: Letters that Java turns into several in upper case, and those of them that have one letter of their own there.
_MANY = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_ONE = {c: "ẞ" if c == "ß" else c.title() for c in _MANY if c == "ß" or len(c.title()) == 1 and c.title() != c}


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x: str, pattern: str, to: str = "") -> str:
        """x with every match of pattern replaced; groups are \\1 and so on."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace(chr(92), '$'))})"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def group(self, x: str, pattern: str, i: int = 1) -> str:
        """The i-th group of the first match, empty without one."""
        return f"regexp_extract({x}, {self.lit(pattern)}, {i})"

    def all(self, x: str, pattern: str, i: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {i})"

    def transform(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def any(self, a: str, v: str, body: str) -> str:
        return f"exists({a}, {v} -> {body})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) AS bigint)"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def holds(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def common(self, a: str, b: str) -> str:
        """Distinct elements of a that b has."""
        return f"array_intersect({a}, {b})"

    def joined(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def at(self, a: str, i: int | str) -> str:
        """The i-th element from 1, from the end if negative; null beyond the array."""
        return f"try_element_at({a}, {i})"

    def slice(self, a: str, first: str, n: str) -> str:
        return f"slice({a}, {first}, {n})"

    def total(self, a: str) -> str:
        return f"aggregate({a}, 0L, (s, x) -> s + x)"

    def starts(self, x: str, s: str) -> str:
        return f"startswith({x}, {s})"

    def ends(self, x: str, s: str) -> str:
        return f"endswith({x}, {s})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def span(self, a: str, b: str) -> str:
        """The numbers from a to b, none if b is less."""
        return f"CASE WHEN {a} > {b} THEN cast(array() AS array<bigint>) ELSE sequence(cast({a} AS bigint), cast({b} AS bigint)) END"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS double)"

    def upper(self, x: str) -> str:
        """Upper case letter by letter: one that has no upper case of one letter stays."""
        each = f"CASE WHEN contains('{_MANY}', c) THEN translate(c, '{''.join(_ONE)}', '{''.join(_ONE.values())}') ELSE upper(c) END"
        return f"CASE WHEN {self.rlike(x, f'[{_MANY}]')} THEN array_join(transform(split({x}, ''), c -> {each}), '') ELSE upper({x}) END"

    def articles(self, x: str) -> str:
        """x with the words a, an and the as spaces."""
        return self.rep(x, r"\b(a|an|the)\b", " ")

    def rows(self, a: str, name: str) -> str:
        """A table function for FROM: one row per element."""
        return f"LATERAL explode({a}) AS u_{name}({name})"

    def records(self, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        """A table function for FROM: the given rows of expressions, once for each row of the table before."""
        each = ", ".join("struct(" + ", ".join(f"{x} AS {n}" for x, n in zip(r, names, strict=True)) + ")" for r in rows)
        return f"LATERAL inline(array({each})) AS records({', '.join(names)})"

    def placed(self, a: str, name: str) -> str:
        """The same with its place from 1 as {name}_at."""
        return f"LATERAL (SELECT at + 1 AS {name}_at, {name} FROM (SELECT posexplode({a}) AS (at, {name})))"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rep(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def all(self, x: str, pattern: str, i: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {i})"

    def transform(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    def any(self, a: str, v: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {body})) > 0)"

    def size(self, a: str) -> str:
        return f"cast(len({a}) AS bigint)"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.lit(pattern)})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def holds(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def joined(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.lit(by)})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def at(self, a: str, i: int | str) -> str:
        return f"list_extract({a}, {i})"

    def slice(self, a: str, first: str, n: str) -> str:
        return f"list_slice({a}, {first}, {first} + {n} - 1)"

    def total(self, a: str) -> str:
        return f"cast(coalesce(list_sum({a}), 0) AS bigint)"

    def starts(self, x: str, s: str) -> str:
        return f"starts_with({x}, {s})"

    def ends(self, x: str, s: str) -> str:
        return f"ends_with({x}, {s})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def span(self, a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def upper(self, x: str) -> str:
        return f"upper({x})"

    def articles(self, x: str) -> str:
        once = lambda y: self.rep(y, r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])", r"\1 \2")
        return once(once(x))

    def rows(self, a: str, name: str) -> str:
        return f"LATERAL (SELECT unnest({a}) AS {name})"

    def records(self, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        each = ", ".join("{" + ", ".join(f"'{n}': {x}" for x, n in zip(r, names, strict=True)) + "}" for r in rows)
        return f"LATERAL (SELECT unnest([{each}], recursive := true)) AS records({', '.join(names)})"

    def placed(self, a: str, name: str) -> str:
        return f"LATERAL (SELECT generate_subscripts({a}, 1) AS {name}_at, unnest({a}) AS {name})"


SPARK, DUCK = Spark(), Duck()
