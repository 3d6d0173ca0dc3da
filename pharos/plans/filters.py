"""The filter language: a recursive-descent parser and its compiler to boolean columns.

    expression := and ("OR" and)*            value := word | 'quoted' | "quoted"
    and        := not ("AND" not)*           word  := letters, digits, _ - .
    not        := "NOT" not | "(" expression ")" | condition
    condition  := value (op value | value "TO" value | ["NOT"] "EXISTS" | ["NOT"] "IN" "[" list "]")
                | "_geoRadius(" lat "," lng "," metres ")"

Logic is two-valued: every compiled predicate is true or false, never null, so NOT is the complement
over all documents and ``!=`` also finds documents without the field. A predicate on an array field is
true if any element satisfies it. Strings compare in lower case, the indexed side trimmed; a literal
that is a finite number also compares as one. A null, ``[]`` or ``{}`` in a VARIANT or nullable column
can't be told from an absent field on typed columns; pass ``present`` columns where that matters.
"""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharos.functions.geo import distance
from pharos.functions.times import epoch, is_time

MAX_DEPTH = 200
RESERVED = ("AND", "OR", "NOT", "IN", "TO", "EXISTS", "_geoRadius")
OPS = ("<=", ">=", "!=", "=", "<", ">")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    field: str
    op: str  # = != < <= > >= TO EXISTS
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.op == "TO":
            return f"{{{self.field}}} {{{self.args[0]}}} TO {{{self.args[1]}}}"
        return f"{{{self.field}}} {self.op}" + "".join(f" {{{a}}}" for a in self.args)


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"{{{self.field}}} IN[{', '.join(f'{{{v}}}' for v in self.values)}]"


@dataclass(frozen=True)
class Not:
    child: object

    def __str__(self) -> str:
        return f"NOT ({self.child})"


@dataclass(frozen=True)
class Many:
    op: str  # AND, OR
    children: tuple

    def __str__(self) -> str:
        return f"{self.op}[{', '.join(map(str, self.children))}]"


@dataclass(frozen=True)
class GeoRadius:
    lat: float
    lng: float
    metres: float

    def __str__(self) -> str:
        return f"_geoRadius({self.lat:g}, {self.lng:g}, {self.metres:g})"


_TOKEN = re.compile(r"""\s*(?:(?P<op><=|>=|!=|=|<|>)|(?P<mark>[()\[\],])|(?P<quote>['"])|(?P<word>[\w\-.]+))""")


def lex(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character `{text[at:].strip()[0]}` at {at}")
        at = m.end()
        if q := m["quote"]:
            value, closed = "", False
            while at < len(text):
                c = text[at]
                if c == "\\" and text[at + 1 : at + 2] == q:
                    value, at = value + q, at + 2
                    continue
                at += 1
                if c == q:
                    closed = True
                    break
                value += c
            if not closed:
                raise FilterError(f"a value that begins with {q} lacks its closing {q}")
            out.append(("value", value, m.start("quote")))
        elif m["word"]:
            out.append(("key" if m["word"] in RESERVED or m["word"].startswith("_geo") else "word", m["word"], m.start("word")))
        else:
            kind = "op" if m["op"] else "mark"
            out.append((kind, m[kind], m.start(kind)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = lex(text), 0, 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k][:2] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, v = self.peek()
        if kind == "end" or value is not None and v != value:
            raise FilterError(f"expected {f'`{value}`' if value else 'a value'}, found `{v}`" if kind != "end" else f"the filter ends where {f'`{value}`' if value else 'a value'} is expected")
        self.at += 1
        return v

    def value(self) -> str:
        kind, v = self.peek()
        if kind == "key":
            raise FilterError(f"`{v}` is a reserved word; write it in quotes to use it as a value")
        if kind not in ("word", "value"):
            raise FilterError(f"expected a value, found `{v}`" if kind != "end" else "the filter ends where a value is expected")
        self.at += 1
        return v

    def chain(self, op: str, sub) -> object:
        found = [sub()]
        while self.peek() == ("key", op):
            self.at += 1
            found.append(sub())
        return found[0] if len(found) == 1 else Many(op, tuple(found))

    def expression(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise FilterError("the filter is nested too deeply")
        out = self.chain("OR", lambda: self.chain("AND", self.negation))
        self.depth -= 1
        return out

    def negation(self):
        odd = False
        while self.peek() == ("key", "NOT"):
            self.at += 1
            odd = not odd
        out = self.primary()
        if odd:
            return out.child if isinstance(out, Not) else Not(out)
        return out

    def primary(self):
        kind, v = self.peek()
        if (kind, v) == ("mark", "("):
            self.at += 1
            out = self.expression()
            self.take(")")
            return out
        if kind == "key" and v == "_geoRadius":
            return self.radius()
        if kind == "key" and v.startswith("_geo"):
            raise FilterError(f"`{v}` is reserved: filter with _geoRadius(latitude, longitude, distance)")
        name = self.value()
        kind, v = self.peek()
        if kind == "op":
            self.at += 1
            return Condition(name, v, (self.value(),))
        if (kind, v) == ("key", "EXISTS"):
            self.at += 1
            return Condition(name, "EXISTS")
        if (kind, v) == ("key", "IN"):
            return self.membership(name)
        if (kind, v) == ("key", "NOT"):
            self.at += 1
            if self.peek() == ("key", "EXISTS"):
                self.at += 1
                return Not(Condition(name, "EXISTS"))
            return Not(self.membership(name))
        if kind in ("word", "value") and self.peek(1) == ("key", "TO"):
            low = self.value()
            self.take("TO")
            return Condition(name, "TO", (low, self.value()))
        raise FilterError(f"expected an operation after `{name}`: =, !=, >, >=, <, <=, TO, EXISTS, IN or _geoRadius")

    def membership(self, name: str) -> In:
        self.take("IN")
        self.take("[")
        values = []
        while self.peek() != ("mark", "]"):
            values.append(self.value())
            if self.peek() != ("mark", "]"):
                self.take(",")
        self.take("]")
        return In(name, tuple(values))

    def radius(self) -> GeoRadius:
        self.at += 1
        self.take("(")
        args = [self.value()]
        while self.peek() == ("mark", ","):
            self.at += 1
            args.append(self.value())
        self.take(")")
        if len(args) != 3:
            raise FilterError("_geoRadius takes a latitude, a longitude and a distance")
        lat, lng, metres = (_finite(a) for a in args)
        if None in (lat, lng, metres):
            raise FilterError("_geoRadius takes three numbers")
        if not -90 <= lat <= 90:
            raise FilterError(f"latitude {lat:g} isn't between -90 and 90")
        if not -180 <= lng <= 180:
            raise FilterError(f"longitude {lng:g} isn't between -180 and 180")
        return GeoRadius(lat, lng, metres)


def _finite(text: str) -> float | None:
    """The number that ``text`` is, if it is finite; suffixes and words for infinities aren't numbers."""
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text.strip()):
        return None
    x = float(text)
    return x if math.isfinite(x) else None


def parse(text: str):
    """AST of a filter, None if it is blank."""
    if not text.strip():
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))  # a level takes a few frames
    p = _Parser(text)
    out = p.expression()
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected `{p.peek()[1]}` after the filter")
    return out


def parse_array(items: list):
    """Outer lists are joined by AND, inner lists by OR; blank strings are left out."""
    outer = []
    for x in items:
        inner = [t for t in (parse(s) for s in ([x] if isinstance(x, str) else x)) if t is not None]
        if inner:
            outer.append(inner[0] if len(inner) == 1 else Many("OR", tuple(inner)))
    return None if not outer else outer[0] if len(outer) == 1 else Many("AND", tuple(outer))


def fields(node) -> set[str]:
    if isinstance(node, (Condition, In)):
        return {node.field}
    if isinstance(node, Not):
        return fields(node.child)
    if isinstance(node, Many):
        return set().union(*map(fields, node.children))
    return {"_geo"} if isinstance(node, GeoRadius) else set()


def compile(node, df: DataFrame, filterable: set[str] | None = None, present: dict[str, Column] | None = None, strict: bool = True) -> Column:
    """A boolean column, never null. Fields that ``filterable`` lacks are an error; fields that ``df``
    lacks match nothing. Without ``strict``, what isn't below a NOT may be null instead of false: the same
    to ``where``, and plain enough to be pushed down to the scan."""
    if node is None:
        return F.lit(True)
    if filterable is not None:
        for f in sorted(fields(node)):
            if not any(f == a or f.startswith(a + ".") for a in filterable):
                raise FilterError(f"attribute `{f}` isn't filterable; filterable are: {', '.join(sorted(filterable)) or 'none'}")
    return _compile(node, df, present or {}, strict)


def _compile(node, df, present, strict) -> Column:
    if isinstance(node, Many):
        out = [_compile(c, df, present, strict) for c in node.children]
        total = out[0]
        for c in out[1:]:
            total = total & c if node.op == "AND" else total | c
        return total
    if isinstance(node, Not):
        return ~_compile(node.child, df, present, True)
    if isinstance(node, GeoRadius):
        if "_geo" not in df.columns:
            return F.lit(False)
        d = distance(F.col("_geo.lat").cast("double"), F.col("_geo.lng").cast("double"), node.lat, node.lng)
        # the box lets row groups be skipped; the circle decides
        reach = math.degrees(node.metres / 6_371_000) + 1e-6
        box = F.col("_geo.lat").between(node.lat - reach, node.lat + reach)
        return F.coalesce(box & (d <= node.metres + 1e-6), F.lit(False)) if strict else box & (d <= node.metres + 1e-6)
    column, kind = _column(df, node.field)
    if column is None and (document := _document(df)) is not None:
        return _compile_variant(node, document)
    if column is None:
        return F.lit(False) if not isinstance(node, Condition) or node.op != "!=" else F.lit(True)
    if isinstance(node, In):
        total = F.lit(False)
        for v in node.values:
            total = total | _any(column, kind, _equals(v), strict)
        return total
    if node.op == "EXISTS":
        return present.get(node.field, column.isNotNull())
    if node.op == "=":
        return _any(column, kind, _equals(node.args[0]), strict)
    if node.op == "!=":
        return ~_any(column, kind, _equals(node.args[0]))
    numbers = [_finite(a) for a in node.args]
    if None in numbers:
        raise FilterError(f"`{node.args[numbers.index(None)]}` isn't a number; {node.op} compares numbers")
    test = {
        "<": lambda x: x < numbers[0], "<=": lambda x: x <= numbers[0], ">": lambda x: x > numbers[0], ">=": lambda x: x >= numbers[0],
        "TO": lambda x: x.between(numbers[0], numbers[-1]),
    }[node.op]
    return _any(column, kind, lambda x, t: test(_number(x, t)) if _number(x, t) is not None else F.lit(False), strict)


def _document(df: DataFrame) -> Column | None:
    """The column of schemaless documents: the only VARIANT of ``df``."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]
    return F.col(f"`{found[0]}`") if len(found) == 1 else None


def _compile_variant(node, document: Column) -> Column:
    """A condition on a field of a schemaless document. Here an absent field is told from a null one: a
    field EXISTS if it's there, whatever its value. Paths go through objects; arrays match by any element."""
    path = "$" + "".join(f"['{p}']" for p in node.field.replace("'", "\\'").split("."))
    value = F.try_variant_get(document, path, "variant")
    if isinstance(node, Condition) and node.op == "EXISTS":
        return value.isNotNull()
    array = F.schema_of_variant(value).startswith("ARRAY")
    values = F.coalesce(F.when(array, F.try_variant_get(value, "$", "array<variant>")), F.array(value))

    def any_of(test) -> Column:
        return F.coalesce(F.exists(values, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))

    def number(x: Column) -> Column:
        return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double"))

    def equals(text: str):
        n = _finite(text)
        same = lambda x: F.lower(F.trim(F.try_variant_get(x, "$", "string"))) == text.lower()
        return (lambda x: same(x) | F.coalesce(number(x) == n, F.lit(False))) if n is not None else same

    if isinstance(node, In):
        total = F.lit(False)
        for v in node.values:
            total = total | any_of(equals(v))
        return total
    if node.op in ("=", "!="):
        found = any_of(equals(node.args[0]))
        return found if node.op == "=" else ~found
    numbers = [_finite(a) for a in node.args]
    if None in numbers:
        raise FilterError(f"`{node.args[numbers.index(None)]}` isn't a number; {node.op} compares numbers")
    test = {
        "<": lambda x: x < numbers[0], "<=": lambda x: x <= numbers[0], ">": lambda x: x > numbers[0], ">=": lambda x: x >= numbers[0],
        "TO": lambda x: x.between(numbers[0], numbers[-1]),
    }[node.op]
    return any_of(lambda x: test(number(x)))


def _column(df: DataFrame, name: str):
    kind: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None, None
        kind = kind[part].dataType
    return F.col(".".join(f"`{p}`" for p in name.split("."))), kind


def _number(x: Column, kind: T.DataType) -> Column | None:
    """Numbers and times (as epoch seconds) compare as doubles; nothing else does."""
    return epoch(x, kind) if is_time(kind) else x.cast("double") if isinstance(kind, T.NumericType) else None


def _equals(value: str):
    number = _finite(value)

    def test(x: Column, kind: T.DataType) -> Column:
        n = _number(x, kind)
        if n is not None:
            return n == number if number is not None else F.lit(False)
        return F.lower(F.trim(x.cast("string"))) == value.lower()

    return test


def _any(column: Column, kind: T.DataType, test, strict: bool = True) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(column, lambda x: F.coalesce(test(x, kind.elementType), F.lit(False))), F.lit(False))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.lit(False)
    return F.coalesce(test(column, kind), F.lit(False)) if strict else test(column, kind)
