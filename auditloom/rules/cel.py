"""Custom rules: a small expression language compiled to columns, so the optimiser folds and pushes them.

A compiled value is a column and a kind. Errors (a missing key, a bad index, a division by zero) are
nulls; ``&&`` and ``||`` take three-valued logic, so a true or false side decides despite an error on
the other. A rule whose condition is null does not fire.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.checks import guarded, none, when
from auditloom.functions.columns import glob_regex
from auditloom.model import LEVELS, issue

_TOKEN = re.compile(
    r"\s*(?:(?P<num>0x[0-9a-fA-F]+u?|\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+u?)|(?P<str>[rR]?(?:\"\"\"(?:.|\n)*?\"\"\"|'''(?:.|\n)*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))"
    r"|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}]))"
)


class RuleError(ValueError):
    """A rule that can't be compiled; names the rule."""


@dataclass
class Value:
    col: Column
    kind: str  # bool, int, double, string, list, map, dyn

    def __post_init__(self):
        assert self.kind in ("bool", "int", "double", "string", "list", "map", "dyn")


@dataclass
class _Token:
    kind: str
    text: str


def tokens(text: str) -> list[_Token]:
    out, at = [], 0
    text = re.sub(r"//[^\n]*", "", text) if "//" in re.sub(r"\"[^\"]*\"|'[^']*'", "", text) else text
    while at < len(text):
        if text[at:].strip() == "":
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected {text[at:].strip()[:1]!r}")
        out.append(_Token(m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, _Token("end", "")]


_ESC = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _string(raw: str) -> str:
    plain = raw[0] in "rR"
    if plain:
        raw = raw[1:]
    q = 3 if raw[:3] in ('"""', "'''") else 1
    body = raw[q:-q]
    if plain:
        return body
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m.group(1)[1:], 16)) if m.group(1)[0] in "ux" and len(m.group(1)) > 1 else _ESC.get(m.group(1), m.group(1)), body)


def page_fields() -> dict[str, Value]:
    """The fields of ``page``."""
    none_s = F.array().cast("array<string>")
    first = F.transform_values(F.coalesce("headers", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.try_element_at(v, F.lit(1)))
    return {
        "url": Value(F.coalesce("url", F.lit("")), "string"),
        "status_code": Value(F.col("status_code"), "int"),
        "content_type": Value(F.coalesce("content_type", F.lit("")), "string"),
        "headers": Value(first, "map"),
        "body": Value(F.coalesce("body", F.lit("")), "string"),
        "links": Value(F.coalesce("links", none_s), "list"),
        "assets": Value(F.coalesce("assets", none_s), "list"),
        "depth": Value(F.col("depth"), "int"),
        "fetch_duration_ms": Value(F.floor(F.col("fetch_duration_ns") / 1_000_000), "int"),
        "in_sitemap": Value(F.coalesce("in_sitemap", F.lit(False)), "bool"),
    }


class _Parser:
    """Precedence climbing over tokens; every method returns a compiled value."""

    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}

    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0
        self.names: dict[str, Value] = {}

    def peek(self) -> _Token:
        return self.toks[self.at]

    def take(self, text: str | None = None) -> _Token:
        t = self.toks[self.at]
        if text is not None and t.text != text:
            raise RuleError(f"expected {text!r}, found {t.text!r}")
        self.at += 1
        return t

    def whole(self) -> Value:
        v = self.ternary()
        if self.peek().kind != "end":
            raise RuleError(f"unexpected {self.peek().text!r}")
        return v

    def ternary(self) -> Value:
        c = self.binary(1)
        if self.peek().text != "?" or self.peek().kind == "str":
            return c
        self.take("?")
        a = self.ternary()
        self.take(":")
        b = self.ternary()
        self.want(c, "bool")
        return Value(F.when(c.col, a.col).when(~c.col, b.col), a.kind if a.kind == b.kind else "dyn")

    def want(self, v: Value, *kinds: str) -> None:
        if v.kind not in kinds and v.kind != "dyn":
            raise RuleError(f"no matching overload for {v.kind}")

    def binary(self, least: int) -> Value:
        left = self.unary()
        while (t := self.peek()).kind in ("op", "id") and self.BINARY.get(t.text, 0) >= least:
            op = self.take().text
            left = self.apply(op, left, self.binary(self.BINARY[op] + 1))
        return left

    def apply(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            self.want(a, "bool")
            self.want(b, "bool")
            x, y = a.col.cast("boolean"), b.col.cast("boolean")
            return Value(x & y if op == "&&" else x | y, "bool")
        if op in ("==", "!="):
            nums = {"int", "double"}
            if a.kind != b.kind and "dyn" not in (a.kind, b.kind) and not {a.kind, b.kind} <= nums:
                raise RuleError(f"no matching overload for {a.kind} {op} {b.kind}")
            e = a.col == b.col
            return Value(e if op == "==" else ~e, "bool")
        if op == "in":
            self.want(b, "list", "map")
            return Value(F.map_contains_key(b.col, a.col) if b.kind == "map" else F.array_contains(b.col, a.col), "bool")
        if op in ("<", "<=", ">", ">="):
            if a.kind != b.kind and "dyn" not in (a.kind, b.kind) and not {a.kind, b.kind} <= {"int", "double"}:
                raise RuleError(f"no matching overload for {a.kind} {op} {b.kind}")
            return Value({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op], "bool")
        if op == "+" and a.kind == b.kind and a.kind in ("string", "list"):
            return Value(F.concat(a.col, b.col), a.kind)
        self.want(a, "int", "double")
        self.want(b, "int", "double")
        if {a.kind, b.kind} == {"int", "double"}:
            raise RuleError(f"no matching overload for {a.kind} {op} {b.kind}")
        whole = a.kind == "int"
        x, y = a.col.cast("bigint" if whole else "double"), b.col.cast("bigint" if whole else "double")
        made = {"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": F.try_multiply(x, y)}.get(op)
        if made is None:
            if op == "/":
                made = F.when(y != 0, F.expr("1") * 0 + F.when(x / y < 0, F.ceil(x / y)).otherwise(F.floor(x / y))) if whole else F.try_divide(x, y)
            else:
                made = F.when(y != 0, x % y)
        return Value(made, "int" if whole else "double")

    def unary(self) -> Value:
        t = self.peek()
        if t.kind == "op" and t.text == "!":
            self.take()
            v = self.unary()
            self.want(v, "bool")
            return Value(~v.col, "bool")
        if t.kind == "op" and t.text == "-":
            self.take()
            v = self.unary()
            self.want(v, "int", "double")
            return Value(-v.col, v.kind)
        return self.postfix(self.primary())

    def primary(self) -> Value:
        t = self.take()
        if t.kind == "num":
            s = t.text.rstrip("u")
            if any(c in s for c in ".eE") and not s.startswith("0x"):
                return Value(F.lit(float(s)), "double")
            return Value(F.lit(int(s, 0)).cast("bigint"), "int")
        if t.kind == "str":
            return Value(F.lit(_string(t.text)), "string")
        if t.text == "(":
            v = self.ternary()
            self.take(")")
            return v
        if t.text == "[":
            items = self.args("]")
            return Value(F.array(*[i.col for i in items]) if items else F.array().cast("array<string>"), "list")
        if t.kind == "id":
            if t.text in ("true", "false"):
                return Value(F.lit(t.text == "true"), "bool")
            if t.text == "null":
                return Value(F.lit(None), "dyn")
            if t.text in self.names:
                return self.names[t.text]
            if t.text == "page":
                return Value(F.lit(None), "map")
            if self.peek().text == "(":
                self.take("(")
                return self.function(t.text)
            raise RuleError(f"undeclared reference to {t.text!r}")
        raise RuleError(f"unexpected {t.text!r}")

    def args(self, close: str) -> list[Value]:
        out: list[Value] = []
        while self.peek().text != close:
            out.append(self.ternary())
            if self.peek().text == ",":
                self.take()
            elif self.peek().text != close:
                raise RuleError(f"expected {close!r}")
        self.take(close)
        return out

    def function(self, name: str) -> Value:
        if name == "has":
            v = self.ternary()
            self.take(")")
            return Value(v.col.isNotNull(), "bool")
        a = self.args(")")
        if name == "size" and len(a) == 1:
            return self.size(a[0])
        if name in ("int", "double", "string", "bool") and len(a) == 1:
            kind = {"int": "bigint", "bool": "boolean"}.get(name, name)
            return Value(a[0].col.try_cast(kind), name)
        if name == "matches" and len(a) == 2:
            return Value(F.rlike(a[0].col, a[1].col), "bool")
        raise RuleError(f"undeclared function {name!r}")

    def size(self, v: Value) -> Value:
        self.want(v, "string", "list", "map")
        return Value((F.length(v.col) if v.kind in ("string", "dyn") else F.size(v.col)).cast("bigint"), "int")

    def postfix(self, v: Value) -> Value:
        is_page = self.toks[self.at - 1].text == "page" and self.toks[self.at - 1].kind == "id" and "page" not in self.names
        while self.peek().kind == "op" and self.peek().text in (".", "["):
            if self.take().text == "[":
                k = self.ternary()
                self.take("]")
                if is_page:
                    raise RuleError("page fields are selected by name")
                if v.kind == "map":
                    v = Value(F.try_element_at(v.col, k.col), "string")
                elif v.kind == "list":
                    self.want(k, "int")
                    v = Value(F.when(k.col >= 0, F.try_element_at(v.col, (k.col + 1).cast("int"))), "string")
                else:
                    raise RuleError(f"no index on {v.kind}")
            else:
                name = self.take().text
                if self.peek().text == "(" and self.peek().kind == "op":
                    self.take("(")
                    v = self.macro(v, name) if name in ("exists", "all", "exists_one", "filter", "map") else self.method(v, name, self.args(")"))
                elif is_page:
                    fields = page_fields()
                    v = fields.get(name) or Value(F.lit(None), "dyn")
                elif v.kind == "map":
                    v = Value(F.try_element_at(v.col, F.lit(name)), "string")
                else:
                    raise RuleError(f"no field {name!r}")
            is_page = False
        return v

    def macro(self, v: Value, name: str) -> Value:
        var = self.take().text
        self.take(",")
        items = F.map_keys(v.col) if v.kind == "map" else v.col
        start = self.at

        def body(x: Column) -> Value:
            self.at = start
            old = self.names.get(var)
            self.names[var] = Value(x, "string")
            try:
                return self.ternary()
            finally:
                if old is None:
                    del self.names[var]
                else:
                    self.names[var] = old

        kind = body(F.lit("")).kind
        end = self.at
        fn = lambda x: body(x).col
        if name == "map":
            out = Value(F.transform(items, fn), "list")
        elif name == "filter":
            out = Value(F.filter(items, fn), "list")
        elif name == "exists":
            out = Value(F.exists(items, fn), "bool")
        elif name == "all":
            out = Value(F.forall(items, fn), "bool")
        else:
            out = Value(F.size(F.filter(items, fn)) == 1, "bool")
        if name != "map" and kind not in ("bool", "dyn"):
            raise RuleError(f"{name} needs a condition")
        self.at = end
        self.take(")")
        return out

    def method(self, v: Value, name: str, a: list[Value]) -> Value:
        s, x = v.col, [i.col for i in a]
        if name == "size" and not a:
            return self.size(v)
        if name == "join" and v.kind == "list":
            return Value(F.array_join(s, "" if not a else _literal(a[0])), "string")
        self.want(v, "string")
        if name in ("contains", "startsWith", "endsWith", "matches") and len(a) == 1:
            return Value({"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[name](s, x[0]), "bool")
        if name in ("lowerAscii", "upperAscii") and not a:
            low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            return Value(F.translate(s, up, low) if name == "lowerAscii" else F.translate(s, low, up), "string")
        if name == "trim" and not a:
            return Value(F.regexp_replace(s, r"^\s+|\s+$", ""), "string")
        if name == "split" and len(a) in (1, 2):
            sep = F.concat(F.lit(r"\Q"), x[0], F.lit(r"\E"))
            return Value(F.split(s, sep, *([x[1].cast("int")] if len(a) == 2 else [])), "list")
        if name == "replace" and len(a) == 2:
            return Value(F.replace(s, x[0], x[1]), "string")
        if name == "substring" and len(a) in (1, 2):
            end = x[1] if len(a) == 2 else F.length(s).cast("bigint")
            ok = (x[0] >= 0) & (end <= F.length(s)) & (x[0] <= end)
            return Value(F.when(ok, F.substring(s, (x[0] + 1).cast("int"), (end - x[0]).cast("int"))), "string")
        if name == "indexOf" and len(a) == 1:
            return Value((F.position(x[0], s) - 1).cast("bigint"), "int")
        if name == "charAt" and len(a) == 1:
            ok = (x[0] >= 0) & (x[0] <= F.length(s))
            return Value(F.when(ok, F.substring(s, (x[0] + 1).cast("int"), F.lit(1))), "string")
        raise RuleError(f"undeclared method {name!r}")


def _literal(v: Value) -> str:
    text = v.col._jc.toString() if hasattr(v.col, "_jc") else str(v.col)
    return text.strip("'\"")


def compile_condition(text: str) -> Column:
    """The condition as a boolean column; an error within it is false."""
    v = _Parser(text).whole()
    if v.kind not in ("bool", "dyn"):
        return F.lit(False)
    return F.coalesce(v.col.try_cast("boolean"), F.lit(False))


@dataclass
class Rule:
    name: str
    severity: str
    condition: str
    message: str = ""
    match: str = ""


def load_rules(path: str) -> list[Rule]:
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    return [Rule(r["name"], str(r.get("severity", "")), r["condition"], str(r.get("message", "")), str(r.get("match") or "")) for r in raw.get("rules", [])]


def rule_checks(rules: list[Rule]) -> Column:
    """All rules as one column of issues. An unknown severity is the empty one."""
    parts = []
    for r in rules:
        try:
            cond = compile_condition(r.condition)
        except RuleError as e:
            raise RuleError(f"rule {r.name!r}: {e}") from None
        if r.match not in ("", "*"):
            rx = glob_regex(r.match)
            if rx is None:
                raise RuleError(f"rule {r.name!r}: bad pattern {r.match!r}")
            cond = F.rlike("url", F.lit(rx)) & cond
        sev = r.severity.strip().lower()
        parts.append(when(cond, issue(r.name, sev if sev in LEVELS else "", r.message)))
    return guarded(F.lit(True), parts) if parts else none()
