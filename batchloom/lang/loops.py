"""DO loops whose turns depend on data: WHILE, UNTIL, and bounds from columns.

The variables that the body changes are a struct; a turn is an expression that makes the next struct from it, and the loop folds it over a counted sequence with a flag that ends it early. Everything
stays inside one expression of the row, so rows don't meet. A counted loop has as many turns as its bounds say; WHILE and UNTIL have WHILE_TURNS at most. A row that needs more raises.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.lang.expressions import Parser, Value
from batchloom.lang.statements import UnsupportedConstruct

if TYPE_CHECKING:
    from batchloom.lang.datastep import DataStep

COUNTED_TURNS, WHILE_TURNS = 100_000, 1_000
_ASSIGN = re.compile(r"(\w+)(?:\s*[\[{(](.*?)[\]})])?\s*=(?!=)\s*(.+)", re.S)
_SUM = re.compile(r"(\w+)\s*\+\s*(.+)", re.S)


class Loop:
    def __init__(self, step: DataStep, head: str, body: list[str]):
        self.step, self.body = step, body
        rest = re.sub(r"^do\b\s*", "", head, flags=re.I)
        self.tests: dict[str, str] = {}
        while m := re.search(r"\b(while|until)\s*(\(.*\))\s*$", rest, re.I | re.S):
            cut = max(rest.lower().rfind("while", 0, m.end()), rest.lower().rfind("until", 0, m.end()))
            self.tests[rest[cut : cut + 5].lower()] = rest[cut + 5 :].strip()
            rest = rest[:cut].strip()
        m = re.fullmatch(r"(\w+)\s*=\s*(.+?)\s+to\s+(.+?)(?:\s+by\s+(.+?))?", rest, re.I | re.S)
        if rest and not m or not (rest or self.tests):
            raise UnsupportedConstruct(head)
        self.index = m[1].lower() if m else None
        self.bounds = [self.number(x) for x in (m[2], m[3], m[4] or "1")] if m else []
        self.emits = [s for s in self._flat(body) if re.match(r"output\b", s, re.I)]
        kinds = {c.lower(): t for c, t in step.df.dtypes}
        names = dict.fromkeys([*([self.index] if self.index else []), *(n for s in self._flat(body) for n in self._changed(s))])
        self.kinds = {n: "string" if kinds.get(n) == "string" else "double" for n in names}
        for s in self._flat(body):  # new variables that get text
            if (m := _ASSIGN.fullmatch(s)) and m[1].lower() in names and m[1].lower() not in kinds:
                value = Parser(m[3], lambda n: F.lit(None).cast(self.kinds.get(n.lower(), "double")) if n.lower() in names else step.resolve(n), step.arrays, step.index, step.p.formats).parse()
                self.kinds[m[1].lower()] = "string" if step.df.select(value.number.alias("x")).dtypes[0][1] == "string" else "double"

    @staticmethod
    def _flat(body: list[str]) -> list[str]:
        """Single statements, without the IF, ELSE and DO around them."""
        out = []
        for s in body:
            while m := re.match(r"(?:if\s+.*?\s+then\b|else\b)\s*(.*)", s, re.I | re.S):
                s = m[1]
            out.append(s.strip())
        return out

    def _changed(self, s: str) -> list[str]:
        m = _ASSIGN.fullmatch(s) or _SUM.fullmatch(s)
        if not m or re.match(r"(output|leave|continue|end|do)\b", s, re.I):
            return []
        name = m[1].lower()
        return self.step.arrays[name] if name in self.step.arrays else [name]

    def number(self, text: str) -> Column:
        d = re.fullmatch(r"dim\((\w+)\)", text.strip(), re.I)
        return F.lit(float(len(self.step.arrays[d[1].lower()]))) if d else self.step.value(text).number.cast("double")

    def value(self, text: str, env: dict[str, Column]) -> Value:
        return Parser(text, lambda n: env[n.lower()] if n.lower() in env else self.step.resolve(n), self.step.arrays, self.step.index, self.step.p.formats).parse()

    # one turn
    def statements(self, body: list[str], env: dict[str, Column], on: Column) -> dict[str, Column]:
        i, last = 0, None
        while i < len(body):
            s = body[i]
            m = re.match(r"if\s+(.*?)\s+then\b\s*(.*)", s, re.I | re.S)
            other = re.match(r"else\b\s*(.*)", s, re.I | re.S)
            if other and last is None:
                raise ValueError("ELSE without IF")
            outer = last if other else on
            if other:
                m = re.match(r"if\s+(.*?)\s+then\b\s*(.*)", other[1], re.I | re.S)
            if m or other:
                test = self.value(m[1], env).test if m else F.lit(True)
                text = m[2] if m else other[1]
                inner = [text]
                if text.strip().lower() == "do":
                    stop = self.step.end_of(body, i)
                    inner, i = body[i + 1 : stop], stop
                env = self.statements(inner, env, outer & test)
                last = outer & ~test if m else None
            else:
                env, last = self.single(s, env, on), None
            i += 1
        return env

    def single(self, s: str, env: dict[str, Column], on: Column) -> dict[str, Column]:
        on = on & ~env["_left_"] & ~env["_next_"]
        word = re.match(r"\w*", s)[0].lower()
        if word in ("leave", "continue") and s.lower() == word:
            flag = "_left_" if word == "leave" else "_next_"
            return {**env, flag: env[flag] | on}
        if word == "output":
            target = s.split()[1].lower() if len(s.split()) > 1 else ""
            row = F.struct(F.lit(target).alias("to"), *[env[n].alias(n) for n in self.kinds])
            return {**env, "_out_": F.when(on, F.concat(env["_out_"], F.array(row))).otherwise(env["_out_"])}
        if m := _ASSIGN.fullmatch(s):
            value, name = self.value(m[3], env).number, m[1].lower()
            if m[2] is None:
                return {**env, name: F.when(on, value.cast(self.kinds[name])).otherwise(env[name])}
            at, members = self.value(m[2], env).number, self.step.arrays[name]
            return {**env, **{x: F.when(on & (at == k), value.cast(self.kinds[x])).otherwise(env[x]) for k, x in enumerate(members, 1)}}
        if m := _SUM.fullmatch(s):
            name = m[1].lower()
            total = F.coalesce(env[name], F.lit(0.0)) + F.coalesce(self.value(m[2], env).number.cast("double"), F.lit(0.0))
            return {**env, name: F.when(on, total).otherwise(env[name])}
        raise UnsupportedConstruct(f"{s} in a loop whose turns depend on data")

    def turn(self, acc: Column) -> Column:
        env: dict[str, Column] = {n: acc[n] for n in self.kinds} | {"_left_": F.lit(False), "_next_": F.lit(False)}
        if self.emits:
            env["_out_"] = acc["_out_"]
        begins = self.value(self.tests["while"], env).test if "while" in self.tests else F.lit(True)
        after = self.statements(self.body, env, F.lit(True))
        done = after["_left_"]
        if "until" in self.tests:
            done = done | self.value(self.tests["until"], after).test
        if self.index:
            after = {**after, self.index: F.when(done, after[self.index]).otherwise(after[self.index] + self.bounds[2])}
            stop = F.when(self.bounds[2] > 0, after[self.index] > self.bounds[1]).otherwise(after[self.index] < self.bounds[1])
            done = done | F.coalesce(stop, F.lit(True))
        ended = self.state(env, F.lit(True))
        return F.when(acc["_done_"], acc).otherwise(F.when(begins, self.state(after, done)).otherwise(ended))

    def state(self, env: dict[str, Column], done: Column) -> Column:
        fields = [env[n].cast(k).alias(n) for n, k in self.kinds.items()]
        return F.struct(*fields, F.coalesce(done, F.lit(False)).alias("_done_"), *([env["_out_"].alias("_out_")] if self.emits else []))

    def run(self, guard: str | None) -> None:
        step = self.step
        env = {n: (F.col(n) if n in {c.lower() for c in step.df.columns} else F.lit(None)).cast(k) for n, k in self.kinds.items()}
        turns: Column = F.lit(WHILE_TURNS)
        never = F.lit(False)
        if self.index:
            a, b, by = self.bounds
            env[self.index] = a
            turns = F.coalesce(F.greatest(F.floor((b - a) / F.nullif(by, F.lit(0.0))) + 1, F.lit(0)).cast("long"), F.lit(0))
            turns = F.when(turns > COUNTED_TURNS, F.raise_error(F.lit(f"a DO loop of more than {COUNTED_TURNS} turns")).cast("long")).otherwise(turns)
            never = turns == 0
        kind = "array<struct<to:string," + ",".join(f"`{n}`:{k}" for n, k in self.kinds.items()) + ">>"
        if self.emits:
            env["_out_"] = F.array().cast(kind)
        begin = self.state(env, never)
        count = F.when(F.col(guard), turns).otherwise(F.lit(0)) if guard else turns
        each = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        folded = F.aggregate(each, begin, lambda acc, _: self.turn(acc))
        step.df = step.df.withColumn("_loop_", folded)
        over = ~F.col("_loop_._done_") & ((F.col(guard) if guard else F.lit(True)))
        checked = F.when(over, F.raise_error(F.lit(f"a DO loop of more than {WHILE_TURNS} turns")).cast(step.df.schema["_loop_"].dataType)).otherwise(F.col("_loop_"))
        step.df = step.df.withColumn("_loop_", checked)
        made = {n: (F.when(F.col(guard), F.col(f"_loop_.{n}")).otherwise(F.col(n) if n in step.df.columns else F.lit(None).cast(k)) if guard else F.col(f"_loop_.{n}")) for n, k in self.kinds.items()}
        if self.emits:
            for to in dict.fromkeys(s.split()[1].lower() if len(s.split()) > 1 else "" for s in self.emits):
                rows = step.df.withColumn("_o_", F.explode(F.filter(F.col("_loop_._out_"), _sent_to(to))))
                step.outputs.append((to or None, rows.withColumns({n: F.col(f"_o_.{n}") for n in self.kinds}).drop("_o_", "_loop_"), F.col(guard) if guard else None))
        step.df = step.df.withColumns(made).drop("_loop_")


def _sent_to(to: str):
    return lambda row: row["to"] == to
