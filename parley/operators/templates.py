"""Text templates as column expressions.

A template has fields ``{{ name }}``, conditions ``{% if a %} .. {% elif b %} .. {% else %} .. {% endif %}`` and loops
``{% for x in list %} .. {% endfor %}``. It is read once, on the driver, and becomes one expression over a table's
columns, so rows are rendered by Spark's own code: no text is parsed, and no Python runs, where the rows are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_PART = re.compile(r"\s*(?:(==|!=|\||\(|\)|,|\.)|('[^']*'|\"[^\"]*\")|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*))")


@dataclass
class Value:
    """An expression with its type; what is not known renders as nothing."""

    column: Column
    kind: T.DataType

    def text(self) -> Column:
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def truth(self) -> Column:
        """Empty texts and lists, zeros and nulls are false."""
        if isinstance(self.kind, (T.ArrayType, T.MapType)):
            held = F.size(self.column) > 0
        elif isinstance(self.kind, T.BooleanType):
            held = self.column
        elif isinstance(self.kind, T.NumericType):
            held = self.column != 0
        elif isinstance(self.kind, T.StringType):
            held = self.column != ""
        else:
            held = self.column.isNotNull()
        return F.coalesce(held, F.lit(False))


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _PART.match(source, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {source[at:]!r} in a template")
        out.append((("mark", "text", "number", "name")[m.lastindex - 1], m.group(m.lastindex)))
        at = m.end()
    return out


class _Expression:
    """Fields, literals, ``.field``, ``not``, ``and``, ``or``, ``==``, ``!=`` and filters, over the names of ``known``."""

    def __init__(self, source: str, known: dict[str, Value]):
        self.tokens, self.at, self.known, self.source = _tokens(source), 0, known, source

    def whole(self) -> Value:
        out = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"cannot read {self.source!r} in a template")
        return out

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.tokens) or (wanted and self.peek() != wanted):
            raise ValueError(f"{wanted or 'more'} is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self) -> Value:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = Value(out.truth() | self.both().truth(), T.BooleanType())
        return out

    def both(self) -> Value:
        out = self.denied()
        while self.peek() == "and":
            self.take()
            out = Value(out.truth() & self.denied().truth(), T.BooleanType())
        return out

    def denied(self) -> Value:
        if self.peek() == "not":
            self.take()
            return Value(~self.denied().truth(), T.BooleanType())
        return self.compared()

    def compared(self) -> Value:
        out = self.filtered()
        if self.peek() in ("==", "!="):
            same = self.take() == "=="
            equal = out.column.eqNullSafe(self.filtered().column)
            out = Value(equal if same else ~equal, T.BooleanType())
        return out

    def filtered(self) -> Value:
        out = self.atom()
        while self.peek() == "|":
            self.take()
            name, given = self.take(), []
            if self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    given.append(self.either())
                    if self.peek() == ",":
                        self.take()
                self.take(")")
            out = _filtered(out, name, given)
        return out

    def atom(self) -> Value:
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.take()
        if kind == "text":
            return Value(F.lit(text[1:-1]), T.StringType())
        if kind == "number":
            return Value(F.lit(float(text)), T.DoubleType()) if "." in text else Value(F.lit(int(text)), T.LongType())
        if kind != "name":
            raise ValueError(f"cannot read {self.source!r} in a template")
        out = self.known.get(text, Value(F.lit(None).cast("string"), T.StringType()))
        while self.peek() == ".":
            self.take()
            field = self.take()
            if isinstance(out, dict):
                out = out[field]
                continue
            inner = out.kind.fields if isinstance(out.kind, T.StructType) else []
            types = {f.name: f.dataType for f in inner}
            out = Value(out.column[field], types[field]) if field in types else Value(F.lit(None).cast("string"), T.StringType())
        if isinstance(out, dict):
            raise ValueError(f"{text} has no value of its own")
        return out


def _filtered(v: Value, name: str, given: list[Value]) -> Value:
    text = T.StringType()
    if name in ("upper", "lower", "trim"):
        return Value({"upper": F.upper, "lower": F.lower, "trim": F.trim}[name](v.text()), text)
    if name == "default":
        return Value(F.coalesce(v.column.cast("string"), given[0].text()), text)
    if name == "join" and isinstance(v.kind, T.ArrayType):
        parts = F.transform(v.column, lambda x: F.coalesce(x.cast("string"), F.lit("")))
        between = given[0].text() if given else F.lit("")
        return Value(F.aggregate(parts, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, between, x))), text)
    if name == "length":
        return Value(F.size(v.column) if isinstance(v.kind, T.ArrayType) else F.length(v.text()), T.LongType())
    raise ValueError(f"unknown filter in a template: {name}")


def _parse(parts: list[str], at: int, until: tuple[str, ...]) -> tuple[list, int]:
    """Nodes from ``parts[at]`` on, up to a tag that begins with one of ``until``; that tag's place."""
    nodes = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{#"):
            at += 1
        elif part.startswith("{{"):
            nodes.append(("show", part[2:-2].strip("-")))
            at += 1
        elif part.startswith("{%"):
            words = part[2:-2].strip("-").strip()
            if words.split(" ")[0] in until:
                return nodes, at
            if words.startswith("if "):
                ways, test = [], words[3:]
                while True:
                    inside, at = _parse(parts, at + 1, ("elif", "else", "endif"))
                    ways.append((test, inside))
                    words = parts[at][2:-2].strip("-").strip()
                    if words == "endif":
                        break
                    test = words[5:] if words.startswith("elif") else None
                nodes.append(("if", ways))
                at += 1
            elif m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", words, re.S):
                inside, at = _parse(parts, at + 1, ("endfor",))
                nodes.append(("for", m[1], m[2], inside))
                at += 1
            else:
                raise ValueError(f"cannot read {part!r} in a template")
        else:
            nodes.append(("text", part))
            at += 1
    if until:
        raise ValueError(f"{until[-1]} is missing in a template")
    return nodes, at


def _round(name: str, over: Value, inside: list, known: dict):
    """A loop's body as a function of an element and its place."""
    n = F.size(over.column)
    number = lambda c: Value(c, T.LongType())

    def each(x: Column, i: Column) -> Column:
        loop = {"index": number(i + 1), "index0": number(i), "first": Value(i == 0, T.BooleanType()), "last": Value(i == n - 1, T.BooleanType()), "length": number(n)}
        return _build(inside, {**known, name: Value(x, over.kind.elementType), "loop": loop})

    return each


def _build(nodes: list, known: dict) -> Column:
    out = [F.lit("")]
    for node in nodes:
        if node[0] == "text":
            out.append(F.lit(node[1]))
        elif node[0] == "show":
            out.append(_Expression(node[1], known).whole().text())
        elif node[0] == "if":
            shown = F.lit("")
            for test, inside in reversed(node[1]):
                part = _build(inside, known)
                shown = part if test is None else F.when(_Expression(test, known).whole().truth(), part).otherwise(shown)
            out.append(shown)
        else:
            _, name, source, inside = node
            over = _Expression(source, known).whole()
            if not isinstance(over.kind, T.ArrayType):
                raise ValueError(f"{source} is not a list")
            out.append(F.coalesce(F.array_join(F.transform(over.column, _round(name, over, inside, known)), ""), F.lit("")))
    return F.concat(*out)


def _trimmed(parts: list[str]) -> list[str]:
    """White space beside a tag's dash goes, and the template's last line break."""
    out = list(parts)
    for i, p in enumerate(parts):
        if p[:2] in ("{{", "{%"):
            if p[2] == "-" and i:
                out[i - 1] = out[i - 1].rstrip()
            if p[-3] == "-" and i + 1 < len(out):
                out[i + 1] = out[i + 1].lstrip()
    return [p for p in out if p]


def compiled(template: str, df: DataFrame, more: dict[str, Column] | None = None) -> Column:
    """The rendered template as a column of ``df``; names are its columns and those of ``more`` (column expressions).

    Values that are null or not known show nothing and are false. A faulty template is an error here, before any job.
    """
    rows = df.select("*", *[c.alias(n) for n, c in (more or {}).items()]) if more else df
    known = {f.name: Value((more or {}).get(f.name, F.col(f"`{f.name}`")), f.dataType) for f in rows.schema.fields}
    parts = _TAG.split(template.removesuffix("\n"))
    nodes, _ = _parse(_trimmed(parts), 0, ())
    return _build(nodes, known)


def load_template(spark, path: str) -> str:
    """A template's text from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()["value"]
