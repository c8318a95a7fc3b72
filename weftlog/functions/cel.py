"""The expression language of predicates and labels, compiled to Spark columns.

Text is cut into tokens, parsed by operator precedence to a small tree, and each node becomes a typed column, so the
optimizer sees plain expressions and nothing is interpreted row by row. Types are known when compiling; a mistake of
types is an error before any job runs. Run-time errors (a division by zero, a failed conversion) are null, and a
predicate that is null is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)|\d+u?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/%!<>?:.,()\[\]]))""")
_LEVEL = {"||": 1, "&&": 2, "<": 3, "<=": 3, ">": 3, ">=": 3, "==": 3, "!=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}


class CelError(ValueError):
    pass


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple:
    """A tree of tuples: ("lit", value), ("id", name), ("call", name, target or None, args), ("op", sign, operands...)."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise CelError(f"cannot read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek(*values: str) -> bool:
        return tokens[place][0] in ("op", "id") and tokens[place][1] in values

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def need(value: str) -> None:
        if take()[1] != value:
            raise CelError(f"{value!r} is missing in {text!r}")

    def ternary() -> tuple:
        cond = binary(1)
        if not peek("?"):
            return cond
        take()
        yes = ternary()
        need(":")
        return ("op", "?", cond, yes, ternary())

    def binary(level: int) -> tuple:
        left = unary()
        while tokens[place][0] in ("op", "id") and _LEVEL.get(tokens[place][1], 0) >= level:
            sign = take()[1]
            left = ("op", sign, left, binary(_LEVEL[sign] + 1))
        return left

    def unary() -> tuple:
        if peek("!", "-"):
            sign = take()[1]
            return ("op", f"u{sign}", unary())
        return postfix(primary())

    def postfix(x: tuple) -> tuple:
        while peek(".", "["):
            if take()[1] == "[":
                x = ("op", "[]", x, ternary())
                need("]")
            else:
                name = take()[1]
                x = ("call", name, x, arguments()) if peek("(") else ("field", name, x)
        return x

    def arguments() -> tuple:
        need("(")
        out = []
        while not peek(")"):
            out.append(ternary())
            if not peek(")"):
                need(",")
        need(")")
        return tuple(out)

    def primary() -> tuple:
        kind, value = take()
        if kind == "num":
            return ("lit", float(value) if re.search(r"[.eE]", value) else int(value.rstrip("u")))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "id":
            if value in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[value])
            return ("call", value, None, arguments()) if peek("(") else ("id", value)
        if value == "(":
            x = ternary()
            need(")")
            return x
        if value == "[":
            out = []
            while not peek("]"):
                out.append(ternary())
                if not peek("]"):
                    need(",")
            need("]")
            return ("list", tuple(out))
        raise CelError(f"{value!r} is out of place in {text!r}")

    tree = ternary()
    if tokens[place][0] != "end":
        raise CelError(f"{tokens[place][1]!r} is out of place in {text!r}")
    return tree


def names_in(text: str) -> set[str]:
    """Identifiers that an expression uses from outside."""
    out: set[str] = set()

    def walk(x: Any, bound: frozenset) -> None:
        if not isinstance(x, tuple) or not x:
            return
        if x[0] == "id":
            if x[1] not in bound:
                out.add(x[1])
        elif x[0] == "call" and x[1] in _MACROS and x[2] and x[3]:
            walk(x[2], bound)
            inner = bound | {x[3][0][1]} if x[3][0][0] == "id" else bound
            for y in x[3][1:]:
                walk(y, inner)
        else:
            for y in x:
                walk(y, bound)

    walk(parse(text), frozenset())
    return out


def attributes_in(text: str) -> set[tuple[str, str, str]]:
    """(function, variable, attribute) of attr() and attrAt() calls on plain variables with a literal name."""
    out: set[tuple[str, str, str]] = set()

    def walk(x: Any) -> None:
        if isinstance(x, tuple):
            if len(x) == 4 and x[0] == "call" and x[1] in ("attr", "attrAt") and x[2] and x[2][0] == "id" and x[3] and x[3][0][0] == "lit":
                out.add((x[1], x[2][1], x[3][0][1]))
            for y in x:
                walk(y)

    walk(parse(text))
    return out


@dataclass(frozen=True)
class Typed:
    """A column and its type: int, double, string, bool, time, duration, value (tagged), null, event, object,
    ("element", event or object: a struct of a listed one),
    ("list", type) or ("map", {name: type})."""

    col: Column
    kind: Any
    name: str = ""
    literal: Any = None


@dataclass
class Scope:
    """What an expression can name. attr(name, attribute) and attr_at(name, attribute, time) give tagged values; facts
    (name, fact) the type, id or time of an element; listed(events or objects) an array of structs of all of them."""

    names: dict[str, Typed] = field(default_factory=dict)
    attr: Callable[[str, str], Column] | None = None
    attr_at: Callable[[str, str, Column], Column] | None = None
    attrs: Callable[[str], Column] | None = None
    fact: Callable[[str, str], Column] | None = None
    totals: Callable[[str], int] | None = None
    listed: Callable[[str], Column] | None = None


_MACROS = {"map", "filter", "all", "exists"}
_NUMERIC = ("int", "double")
_SQL = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "time": "timestamp"}


def untag(x: Typed, kind: str) -> Typed:
    """A tagged value as a plain type; null where it is of another."""
    if x.kind != "value":
        return x
    v = x.col
    col = {"double": F.coalesce(v["d"], v["i"].cast("double")), "int": v["i"], "string": v["s"], "bool": v["b"], "time": v["ts"]}[kind]
    return Typed(col, kind)


def _lit(v: Any) -> Typed:
    if v is None:
        return Typed(F.lit(None), "null")
    kind = {bool: "bool", int: "int", float: "double", str: "string"}[type(v)]
    return Typed(F.lit(v).cast(_SQL[kind]), kind, literal=v)


_SECONDS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def duration_seconds(text: str) -> float:
    """Seconds of a text such as 1h30m or -2.5s."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", text)
    if not parts or re.sub(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", "", text.lstrip("+-")):
        raise CelError(f"not a duration: {text!r}")
    return sum(float(n) * _SECONDS[u] for n, u in parts) * (-1 if text.startswith("-") else 1)


def _listed(x: Typed) -> bool:
    return isinstance(x.kind, tuple) and x.kind[0] == "element"


def _handle(x: Typed) -> Typed:
    """A listed element as its id, as a variable is."""
    return Typed(x.col["id"], x.kind[1]) if _listed(x) else x


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def run(self, x: tuple) -> Typed:
        return getattr(self, f"_{x[0]}")(*x[1:])

    def _lit(self, v: Any) -> Typed:
        return _lit(v)

    def _id(self, name: str) -> Typed:
        if name == "now":
            return Typed(F.current_timestamp(), "time")
        if name not in self.scope.names:
            raise CelError(f"unknown name {name}")
        return replace(self.scope.names[name], name=name)

    def _list(self, items: tuple) -> Typed:
        own = [self.run(x) for x in items]
        kinds = {x.kind for x in own}
        if kinds <= set(_NUMERIC) and len(kinds) == 2:
            return Typed(F.array(*[x.col.cast("double") for x in own]), ("list", "double"))
        if len(kinds) > 1:
            raise CelError("a list of mixed types")
        return Typed(F.array(*[x.col for x in own]), ("list", own[0].kind if own else "null"))

    def _field(self, name: str, target: tuple) -> Typed:
        x = self.run(target)
        if not isinstance(x.kind, tuple) or x.kind[0] != "map" or name not in x.kind[1]:
            raise CelError(f"no field {name}")
        return Typed(x.col[name], x.kind[1][name], f"{x.name}.{name}")

    def _op(self, sign: str, *args: tuple) -> Typed:
        own = [_handle(self.run(a)) for a in args]
        if sign == "?":
            cond, yes, no = own
            yes, no = self._same(yes, no)
            return Typed(F.when(self._bool(cond), yes.col).otherwise(no.col), yes.kind if yes.kind != "null" else no.kind)
        if sign == "u!":
            return Typed(~self._bool(own[0]), "bool")
        if sign == "u-":
            x = untag(own[0], "double")
            return Typed(-x.col, x.kind)
        if sign == "[]":
            return self._at(*own)
        a, b = own
        if sign in ("&&", "||"):
            a, b = self._bool(a), self._bool(b)
            return Typed(a & b if sign == "&&" else a | b, "bool")
        if sign == "in":
            if not isinstance(b.kind, tuple) or b.kind[0] != "list":
                raise CelError("in needs a list")
            return Typed(F.coalesce(F.array_contains(b.col, untag(a, b.kind[1]).col), F.lit(False)), "bool")
        a, b = self._same(a, b)
        if sign in ("==", "!="):
            equal = a.col.eqNullSafe(b.col)
            return Typed(equal if sign == "==" else ~equal, "bool")
        if sign in ("<", "<=", ">", ">="):
            return Typed({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[sign], "bool")
        return self._arithmetic(sign, a, b)

    def _arithmetic(self, sign: str, a: Typed, b: Typed) -> Typed:
        if sign == "+" and a.kind == b.kind == "string":
            return Typed(F.concat(a.col, b.col), "string")
        if sign == "+" and isinstance(a.kind, tuple):
            return Typed(F.concat(a.col, b.col), a.kind)
        if sign == "-" and a.kind == b.kind == "time":
            return Typed((F.unix_micros(a.col) - F.unix_micros(b.col)) / F.lit(1e6), "duration")
        if a.kind == "time" or b.kind == "time":
            t, d = (a, b) if a.kind == "time" else (b, a)
            micros = (d.col * 1e6).cast("bigint")
            return Typed(F.timestamp_micros(F.unix_micros(t.col) + (micros if sign == "+" else -micros)), "time")
        kind = "duration" if "duration" in (a.kind, b.kind) else "double" if "double" in (a.kind, b.kind) else "int"
        if a.kind not in (*_NUMERIC, "duration") or b.kind not in (*_NUMERIC, "duration"):
            raise CelError(f"{sign} between {a.kind} and {b.kind}")
        if sign == "/":
            return Typed(F.try_divide(a.col, b.col) if kind != "int" else F.try_divide(a.col - F.try_mod(a.col, b.col), b.col).cast("bigint"), kind)
        if sign == "%":
            return Typed(F.try_mod(a.col, b.col), kind)
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](a.col, b.col), kind)

    def _at(self, x: Typed, i: Typed) -> Typed:
        if isinstance(x.kind, tuple) and x.kind[0] == "list":
            return Typed(F.try_element_at(x.col, (i.col + 1).cast("int")), x.kind[1])
        if isinstance(x.kind, tuple) and x.kind[0] == "map" and isinstance(i.col, Column):
            raise CelError("index a binding by .name")
        raise CelError("only lists can be indexed")

    def _same(self, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        if a.kind == "value" and b.kind == "value":
            text = lambda x: Typed(F.to_json(x.col), "string")
            return text(a), text(b)
        target = b.kind if a.kind == "value" else a.kind
        if target == "int" and "value" in (a.kind, b.kind):
            target = "double"
        if target in _SQL:
            a, b = untag(a, target), untag(b, target)
        if {a.kind, b.kind} == {"int", "double"}:
            return Typed(a.col.cast("double"), "double"), Typed(b.col.cast("double"), "double")
        return a, b

    def _bool(self, x: Typed) -> Column:
        x = untag(x, "bool")
        if x.kind != "bool":
            raise CelError(f"a boolean is needed, not {x.kind}")
        return x.col

    def _call(self, name: str, target: tuple | None, args: tuple) -> Typed:
        if target is not None and name in _MACROS:
            return self._macro(name, self.run(target), args)
        if name == "has":
            try:
                return Typed(self.run(args[0]).col.isNotNull(), "bool")
            except CelError:
                return Typed(F.lit(False), "bool")
        own = [self.run(a) for a in ((target,) if target is not None else ()) + args]
        found = getattr(self, f"f_{name}", None)
        if not found:
            raise CelError(f"unknown function {name}")
        return found(*own)

    def _macro(self, name: str, x: Typed, args: tuple) -> Typed:
        if not isinstance(x.kind, tuple) or x.kind[0] != "list" or len(args) != 2 or args[0][0] != "id":
            raise CelError(f"{name} needs a list, a name and an expression")
        kinds: list[Any] = []

        def body(v: Column) -> Column:
            inner = Compiler(replace(self.scope, names={**self.scope.names, args[0][1]: Typed(v, x.kind[1])}))
            y = inner.run(args[1])
            kinds.append(y.kind)
            return y.col if name == "map" else F.coalesce(inner._bool(y), F.lit(False))

        col = {"map": F.transform, "filter": F.filter, "all": F.forall, "exists": F.exists}[name](x.col, body)
        return Typed(col, ("list", kinds[0]) if name == "map" else x.kind if name == "filter" else "bool")

    # Functions, the target of a method first.

    def f_type(self, x: Typed) -> Typed:
        if _listed(x):
            return Typed(x.col["type"], "string")
        return Typed(self.scope.fact(x.name, "type"), "string")

    def f_id(self, x: Typed) -> Typed:
        x = _handle(x)
        return Typed(x.col, "string")

    def f_time(self, x: Typed) -> Typed:
        if x.kind == ("element", "event"):
            return Typed(x.col["time"], "time")
        if x.kind != "event":
            raise CelError("only events have a time")
        return Typed(self.scope.fact(x.name, "time"), "time")

    def f_attr(self, x: Typed, name: Typed) -> Typed:
        if _listed(x):
            return Typed(F.try_element_at(x.col["attrs"], F.lit(_text(name))), "value")
        return Typed(self.scope.attr(x.name, _text(name)), "value")

    def f_attrAt(self, x: Typed, name: Typed, at: Typed) -> Typed:  # noqa: N802
        return Typed(self.scope.attr_at(x.name, _text(name), at.col), "value")

    def f_attrs(self, x: Typed) -> Typed:
        return Typed(self.scope.attrs(x.name), ("list", ("map", {"name": "string", "value": "value", "time": "time"})))

    def f_numEvents(self) -> Typed:  # noqa: N802
        return Typed(F.lit(self.scope.totals("events")).cast("bigint"), "int")

    def f_numObjects(self) -> Typed:  # noqa: N802
        return Typed(F.lit(self.scope.totals("objects")).cast("bigint"), "int")

    def f_events(self) -> Typed:
        return Typed(self.scope.listed("events"), ("list", ("element", "event")))

    def f_objects(self) -> Typed:
        return Typed(self.scope.listed("objects"), ("list", ("element", "object")))

    def _extreme(self, own: tuple[Typed, ...], of_list: Callable, of_many: Callable) -> Typed:
        if len(own) == 1:
            x = own[0]
            if isinstance(x.kind, tuple):
                return Typed(of_list(x.col), x.kind[1]) if x.kind[1] != "value" else Typed(of_list(F.transform(x.col, lambda v: untag(Typed(v, "value"), "double").col)), "double")
            return x
        own = tuple(untag(x, "double") for x in own)
        kind = "double" if any(x.kind == "double" for x in own) else own[0].kind
        if len({x.kind for x in own} - set(_NUMERIC)) and len({x.kind for x in own}) > 1:
            raise CelError("values that cannot be compared")
        missing = own[0].col.isNull()
        for x in own[1:]:
            missing = missing | x.col.isNull()
        return Typed(F.when(~missing, of_many(*[x.col for x in own])), kind)

    def f_min(self, *own: Typed) -> Typed:
        return self._extreme(own, F.array_min, F.least)

    def f_max(self, *own: Typed) -> Typed:
        return self._extreme(own, F.array_max, F.greatest)

    def _numbers(self, x: Typed) -> Column:
        kind = x.kind[1]

        def number(v: Column) -> Column:
            if kind == "value":
                v = F.coalesce(v["d"], v["i"].cast("double"), v["s"].try_cast("double"))
            elif kind in _NUMERIC or kind == "string":
                v = v.try_cast("double")
            else:
                v = F.lit(0.0)
            return F.coalesce(v, F.lit(0.0))

        return F.aggregate(x.col, F.lit(0.0), lambda a, v: a + number(v))

    def f_sum(self, x: Typed) -> Typed:
        return Typed(self._numbers(x), "double")

    def f_avg(self, x: Typed) -> Typed:
        return Typed(F.when(F.size(x.col) == 0, F.lit(float("nan"))).otherwise(self._numbers(x) / F.greatest(F.size(x.col), F.lit(1))), "double")

    def f_size(self, x: Typed) -> Typed:
        x = untag(x, "string")
        return Typed((F.size(x.col) if isinstance(x.kind, tuple) else F.length(x.col)).cast("bigint"), "int")

    def f_contains(self, x: Typed, y: Typed) -> Typed:
        if isinstance(x.kind, tuple):
            return Typed(F.coalesce(F.array_contains(x.col, y.col), F.lit(False)), "bool")
        return Typed(F.contains(untag(x, "string").col, untag(y, "string").col), "bool")

    def f_startsWith(self, x: Typed, y: Typed) -> Typed:  # noqa: N802
        return Typed(F.startswith(untag(x, "string").col, untag(y, "string").col), "bool")

    def f_endsWith(self, x: Typed, y: Typed) -> Typed:  # noqa: N802
        return Typed(F.endswith(untag(x, "string").col, untag(y, "string").col), "bool")

    def f_matches(self, x: Typed, y: Typed) -> Typed:
        return Typed(F.rlike(untag(x, "string").col, untag(y, "string").col), "bool")

    def f_string(self, x: Typed) -> Typed:
        if x.kind == "value":
            v = x.col
            return Typed(F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), _stamp(v["ts"])), "string")
        return Typed(_stamp(x.col) if x.kind == "time" else F.concat(x.col.cast("string"), F.lit("s")) if x.kind == "duration" else x.col.cast("string"), "string")

    def f_double(self, x: Typed) -> Typed:
        if x.kind == "value":
            return Typed(F.coalesce(x.col["d"], x.col["i"].cast("double"), x.col["s"].try_cast("double")), "double")
        return Typed(x.col.try_cast("double"), "double")

    def f_int(self, x: Typed) -> Typed:
        if x.kind == "time":
            return Typed(F.unix_seconds(x.col), "int")
        return Typed(self.f_double(x).col.try_cast("bigint"), "int")

    def f_duration(self, x: Typed) -> Typed:
        return Typed(F.lit(duration_seconds(_text(x))), "duration")

    def f_timestamp(self, x: Typed) -> Typed:
        return Typed(F.try_to_timestamp(untag(x, "string").col), "time")


def _stamp(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _text(x: Typed) -> str:
    if not isinstance(x.literal, str):
        raise CelError("a literal text is needed")
    return x.literal


def compile_to(text: str, scope: Scope) -> Typed:
    return Compiler(scope).run(parse(text))


def predicate(text: str, scope: Scope) -> Column:
    """A boolean column that is never null."""
    x = untag(compile_to(text, scope), "bool")
    if x.kind != "bool":
        raise CelError("Got non-bool CEL result!")
    return F.coalesce(x.col, F.lit(False))


def label(text: str, scope: Scope) -> Column:
    """A label's value: lists and maps are null, times and durations text."""
    x = compile_to(text, scope)
    if isinstance(x.kind, tuple) or x.kind in ("event", "object", "null"):
        return F.lit(None).cast("string")
    if x.kind == "value":
        return Compiler(scope).f_string(x).col
    return Compiler(scope).f_string(x).col if x.kind in ("time", "duration") else x.col
