"""Expressions of the dialect as columns.

Comparisons follow the missing-value rules of ``batchloom.missing`` and count as 0 or 1 in arithmetic; ``.`` is the missing number, a blank
text is missing; division by zero gives missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom import functions, missing
from batchloom.lang.names import expanded
from batchloom.lang.statements import UnsupportedConstruct
from batchloom.operators import summaries

_TOKEN = re.compile(
    r"\s*(?:(?P<lit>'(?:[^']|'')*'(?:dt|d|t)?|\"(?:[^\"]|\"\")*\"(?:dt|d|t)?)|(?P<num>\d+\.?\d*(?:e[-+]?\d+)?|\.\d+)|(?P<name>(?:first|last)\.\w+|[A-Za-z_]\w*)|(?P<fmt>\$\w+\.\d*)|(?P<op>\*\*|\|\||<=|>=|\^=|~=|<>|[-+*/=<>(),{}\[\]&|^~.$:]))",
    re.I,
)
#: Comparison operators by their words and signs.
_COMPARE = {"=": "eq", "eq": "eq", "^=": "ne", "~=": "ne", "<>": "ne", "ne": "ne", "<": "lt", "lt": "lt", ">": "gt", "gt": "gt", "<=": "le", "le": "le", ">=": "ge", "ge": "ge"}
_TESTS = {"eq": missing.equal, "ne": missing.not_equal, "lt": missing.less, "gt": missing.greater, "le": missing.less_equal, "ge": missing.greater_equal}
#: Functions whose arguments may be formats or must be plain values.
_FORMATS = {"put", "input"}


@dataclass
class Value:
    """A column with what is known about it: a condition, or a plain literal."""

    col: Column
    condition: bool = False
    literal: object = None
    missing: bool = False

    @property
    def number(self) -> Column:
        return missing.number(self.col) if self.condition else self.col

    @property
    def test(self) -> Column:
        """As a condition: numbers are true unless 0 or missing."""
        return self.col if self.condition else F.coalesce(self.col.cast("double") != 0, F.lit(False))


def tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise ValueError(f"cannot read {text[i : i + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
    return out


class Parser:
    """Recursive-descent parser over a column resolver; ``arrays`` maps array names to their member columns."""

    def __init__(self, text: str, resolve: Callable[[str], Column], arrays: dict[str, list[str]] | None = None, index: dict[str, int] | None = None, formats: dict[str, dict] | None = None, call: Callable[[str, str], Value] | None = None, columns: Sequence[tuple[str, str]] = ()):
        self.formats, self.special, self.columns = formats or {}, call, columns
        self.t, self.i, self.resolve, self.arrays, self.index = tokens(text), 0, resolve, arrays or {}, index or {}

    def peek(self) -> str:
        return self.t[self.i][1].lower() if self.i < len(self.t) else ""

    def take(self, *words: str) -> bool:
        if self.peek() in words and self.t[self.i][0] in ("op", "name"):
            self.i += 1
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"expected {word}, found {self.peek() or 'the end'}")

    def parse(self) -> Value:
        out = self.either()
        if self.i < len(self.t):
            raise ValueError(f"unexpected {self.t[self.i][1]}")
        return out

    def either(self) -> Value:
        out = self.both()
        while self.take("or", "|"):
            out = Value(out.test | self.both().test, True)
        return out

    def both(self) -> Value:
        out = self.negation()
        while self.take("and", "&"):
            out = Value(out.test & self.negation().test, True)
        return out

    def negation(self) -> Value:
        if self.take("not", "^", "~"):
            return Value(~self.negation().test, True)
        return self.comparison()

    def comparison(self) -> Value:
        out = self.joined()
        while True:
            negate = False
            if self.peek() == "not" and self.i + 1 < len(self.t) and self.t[self.i + 1][1].lower() in ("in", "between", "like", "contains"):
                self.i += 1
                negate = True
            if self.peek() in _COMPARE:
                op = _COMPARE[self.t[self.i][1].lower()]
                self.i += 1
                right = self.joined()
                if right.missing or out.missing:
                    other = out.col if right.missing else right.col
                    empty = missing.missing_text(other) if "" in (right.literal, out.literal) else other.isNull()
                    out = Value({"eq": empty, "ne": ~empty, "gt": ~empty, "le": empty}.get(op, F.lit(False) if op == "lt" else F.lit(True)), True)
                else:
                    out = Value(_TESTS[op](out.number, right.number), True)
            elif self.take("in"):
                self.expect("(")
                items = [self.sum()]
                while self.peek() != ")":
                    self.take(",")
                    items.append(self.sum())
                self.expect(")")
                test = F.coalesce(out.number.isin(*[v.literal if v.literal is not None else v.col for v in items]), F.lit(False))
                out = Value(~test if negate else test, True)
            elif self.take("between"):
                low = self.joined()
                self.expect("and")
                test = missing.less_equal(low.col, out.col) & missing.less_equal(out.col, self.joined().col)
                out = Value(~test if negate else test, True)
            elif self.take("like", "contains"):
                like = self.t[self.i - 1][1].lower() == "like"
                pattern = self.joined().literal
                test = F.coalesce(out.col.like(pattern) if like else out.col.contains(pattern), F.lit(False))
                out = Value(~test if negate else test, True)
            elif self.take("is"):
                negate = self.take("not")
                if not self.take("missing", "null"):
                    raise ValueError("expected MISSING or NULL")
                test = missing.missing_text(out.col.cast("string"))
                out = Value(~test if negate else test, True)
            else:
                return out

    def joined(self) -> Value:
        out = self.sum()
        while self.take("||"):
            out = Value(F.concat(_text(out), _text(self.sum())))
        return out

    def sum(self) -> Value:
        out = self.product()
        while self.peek() in ("+", "-"):
            plus = self.take("+") or not self.take("-")
            right = self.product()
            out = Value(out.number + right.number if plus else out.number - right.number)
        return out

    def product(self) -> Value:
        out = self.unary()
        while self.peek() in ("*", "/"):
            times = self.take("*") or not self.take("/")
            right = self.unary()
            out = Value(out.number * right.number if times else missing.divide(out.number, right.number))
        return out

    def unary(self) -> Value:
        if self.take("-"):
            v = self.unary()
            return Value(-v.number, literal=None if v.literal is None else -v.literal)
        self.take("+")
        out = self.atom()
        if self.take("**"):
            out = Value(F.pow(out.number, self.unary().number))
        return out

    def atom(self) -> Value:
        if self.i >= len(self.t):
            raise ValueError("the expression ends too early")
        kind, word = self.t[self.i]
        self.i += 1
        if kind == "num":
            value = float(word) if re.search(r"[.e]", word, re.I) else int(word)
            return Value(F.lit(value), literal=value)
        if kind == "lit":
            return _literal(word)
        if word == "(":
            out = self.either()
            self.expect(")")
            return out
        if word == ".":
            return Value(F.lit(None).cast("double"), missing=True)
        if kind == "name":
            name = word.lower()
            if name in self.arrays and self.peek() in ("{", "[", "("):
                return self.member(name)
            if self.peek() == "(" and "." not in name:
                return self.call(name)
            if name in self.index:
                return Value(F.lit(self.index[name]), literal=self.index[name])
            return Value(self.resolve(word))
        raise ValueError(f"unexpected {word}")

    def member(self, name: str) -> Value:
        """An array element; an index that is known only in the row picks from all members, and one outside the array raises."""
        close = {"{": "}", "[": "]", "(": ")"}[self.peek()]
        self.i += 1
        at = self.sum()
        self.expect(close)
        if isinstance(at.literal, int):
            return Value(self.resolve(self.arrays[name][at.literal - 1]))
        return Value(F.element_at(F.array(*[self.resolve(c) for c in self.arrays[name]]), at.number.cast("int")))

    def call(self, name: str) -> Value:
        if name in ("lag", "dif") or re.fullmatch(r"(lag|dif)\d+", name):
            if self.special is None:
                raise ValueError(f"{name.upper()} works in a DATA step only")
            start = self.i
            self.expect("(")
            inner = self.either()
            self.expect(")")
            return self.special(name, inner, " ".join(w for _, w in self.t[start : self.i]))
        self.expect("(")
        args: list[object] = []
        if self.take("of"):
            plain = ""
            while self.peek() != ")":
                word = self.t[self.i][1]
                self.i += 1
                if word.lower() in self.arrays:
                    self.i += 3 if self.peek() in ("{", "[", "(") else 0
                    args += [self.resolve(c) for c in self.arrays[word.lower()]]
                else:
                    plain += " " if word == "," else word if word in "-:" else f" {word}"
            args += [self.resolve(c) for c in expanded(plain.replace("- ", "-"), self.columns)]
        else:
            while self.peek() != ")":
                if name in _FORMATS and args:
                    args.append(self.format_name())
                else:
                    v = self.either()
                    args.append(v.literal if v.literal is not None and not (name in ("coalesce", "sum", "max", "min", "mean", "ifn", "ifc")) else v.col if name in ("ifn", "ifc") and not args else v.number)
                self.take(",")
        self.expect(")")
        if name in ("ifn", "ifc"):
            args[0] = args[0] if isinstance(args[0], Column) else F.lit(args[0])
        if name == "dim":
            raise ValueError("DIM needs an array name")
        if name == "put" and (found := user_format(args[1], self.formats)):
            if "table" in found:
                if self.special is None:
                    raise UnsupportedConstruct(f"PUT with the format {args[1]} outside a DATA step's assignments")
                return self.special(f"put {args[1]}", Value(args[0] if isinstance(args[0], Column) else F.lit(args[0])), "")
            return Value(summaries.format_value(args[0] if isinstance(args[0], Column) else F.lit(args[0]), **found))
        return Value(functions.call(name, *args))

    def format_name(self) -> str:
        out = ""
        while self.peek() not in (")", ","):
            out += self.t[self.i][1]
            self.i += 1
        return out


def _text(v: Value) -> Column:
    """A value in a concatenation: a number is written by BEST12, right-aligned."""
    x = v.number
    number = F.lpad(functions.call("put", x.try_cast("double"), "best12."), 12, " ")
    return F.coalesce(F.when(F.typeof(x).isin("double", "float", "int", "bigint", "smallint", "tinyint"), number).otherwise(x.cast("string")), F.lit(""))


def user_format(name: str, formats: dict[str, dict]) -> dict | None:
    """The user format of a name like ``band.`` or ``$seg8.``."""
    base = name.lower().lstrip("$").split(".")[0]
    return formats.get(base) or formats.get(base.rstrip("0123456789"))


def _literal(word: str) -> Value:
    m = re.fullmatch(r"(['\"])(.*)\1(dt|d|t)?", word, re.I | re.S)
    text, kind = m[2].replace(m[1] * 2, m[1]), (m[3] or "").lower()
    if kind == "d":
        return Value(F.to_date(F.lit(text.title()), "ddMMMyyyy") if len(re.sub(r"\D", "", text)) > 4 else F.to_date(F.lit(text.title()), "ddMMMyy"))
    if kind == "dt":
        day, _, clock = text.partition(":")
        return Value(F.to_timestamp(F.lit(f"{day.title()}:{clock}"), F.lit("ddMMMyyyy:HH:mm:ss" if clock.count(":") == 2 else "ddMMMyyyy:HH:mm")))
    if kind == "t":
        parts = [float(p) for p in text.split(":")] + [0.0]
        value = parts[0] * 3600 + parts[1] * 60 + parts[2]
        return Value(F.lit(value), literal=value)
    return Value(F.lit(text), literal=text, missing=not text.strip())
