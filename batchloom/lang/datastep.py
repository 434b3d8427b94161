"""Compiles a DATA step to DataFrame operations.

Statements run in order on the frame's columns; a condition is stored in a column when its IF is met, so later assignments can't change
it. RETAIN and sum statements are recognised (running sum, counter, carry-forward). With a reset at FIRST.key they become windows over one (by, order) specification; without one they run
along all rows of the sorted dataset as carries over its range partitions, and so do LAG and DIF, whose queues span groups and count only the rows that reach them. ``s = a * s + b``, also
inside MAX and MIN, is a recurrence composed run by run. Loops with constant bounds are unrolled; others fold their variables in a loop expression with a limit on turns.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.lang.expressions import Parser, Value, tokens, user_format
from batchloom.lang.loops import Loop
from batchloom.lang.names import expanded
from batchloom.lang.statements import UnsupportedConstruct
from batchloom.operators import datastep, merging, scans, shaping, summaries

if TYPE_CHECKING:
    from batchloom.lang.program import Program


class DataStep:
    def __init__(self, program: Program, head: str, body: list[str]):
        from batchloom.lang.program import _by, _datasets, _options, _statement, _words

        self.p, self.body = program, body
        self.targets = _datasets(head.split(None, 1)[1])
        self.options_of, self.words, self.statement_of = _options, _words, _statement
        self.by = _by(_statement(body, "by"))
        self.keep = " ".join(s[4:] for s in body if re.match(r"keep\b", s, re.I))
        self.drop = " ".join(s[4:] for s in body if re.match(r"drop\b", s, re.I))
        self.arrays: dict[str, list[str]] = {}
        self.lengths: dict[str, int] = {}
        self.retained: set[str] = set()
        self.resets: dict[str, tuple[str, Value]] = {}
        self.temporary: set[str] = set()
        self.outputs: list[tuple[str | None, DataFrame, Column | None]] = []
        self.index: dict[str, int] = {}
        self.guards = 0
        self.current: str | None = None  # guard of the statements that run now
        self.initial: dict[str, Value] = {}
        self.pending: dict[str, scans.Carry] = {}  # retained variables along all rows that no statement has read yet
        self.returned: str | None = None
        self.calls = 0
        self.end: str | None = None
        self.hashes: dict[str, dict[str, list[str] | str]] = {}
        self.order: list[str] = []
        self.df: DataFrame | None = None

    # reading
    def read(self) -> None:
        from batchloom.lang.program import _datasets

        for s in self.body:
            m = re.match(r"(set|merge|update)\s+(.*)", s, re.I | re.S)
            if m:
                named = m[2]
                if found := re.search(r"\bend\s*=\s*(\w+)", named, re.I):
                    named, self.end = named[: found.start()] + named[found.end() :], found[1].lower()
                if other := re.search(r"\b(key|point|nobs|curobs|indsname)\s*=", re.sub(r"\([^()]*\)", "", named), re.I):
                    raise UnsupportedConstruct(f"{m[1].upper()} with {other[1].upper()}=")
                opened = [self.p.opened(n, o) for n, o in _datasets(named)]
                plain = [k.lstrip("-") for k in self.by]
                self.order = opened[0][1]
                for _, _, flag in opened:
                    if flag:
                        self.temporary.add(flag.lower())
                if m[1].lower() == "set":
                    frames = [df.withColumn(f.lower(), F.lit(1)) if f else df for df, _, f in opened]
                    if len(frames) > 1 and self.by:  # interleaved: equal keys in order of the datasets
                        frames = [f.withColumn("_source_", F.lit(i)) for i, f in enumerate(frames)]
                        rest = [k for _, order, _ in opened for k in order if k.lstrip("-") not in plain]
                        self.order = list(dict.fromkeys([*self.by, "_source_", *rest])) if all(order for _, order, _ in opened) else []
                        self.temporary.add("_source_")
                    self.df = datastep.concatenate(*frames)
                    flags = [f.lower() for _, _, f in opened if f]
                    self.df = self.df.fillna(0, flags) if flags else self.df
                elif m[1].lower() == "merge":
                    if not plain:
                        self.one_to_one(opened)
                        continue
                    self.df, names = opened[0][0], [f.lower() if f else None for _, _, f in opened]
                    if names[0]:
                        self.df = self.df.withColumn(names[0], F.lit(1))
                    for (df, _, _), f in zip(opened[1:], names[1:], strict=True):
                        self.df = self.merged(self.df, df.withColumn(f, F.lit(1)) if f else df, plain, opened)
                    flags = [n for n in names if n]
                    self.df = self.df.fillna(0, flags) if flags else self.df
                else:
                    self.df = merging.update(opened[0][0], opened[1][0], plain)
        if self.df is None:
            self.df = self.p.spark.range(1).select()
        for where in self.p.conditions(self.body):
            self.df = self.df.where(self.value(where).test)
        if self.end:  # 1 in the last row of the order
            self.place()
            last = self.df.agg(F.max(F.struct("_p_", "_k_")).alias("_last_"))  # one row
            self.df = self.df.join(F.broadcast(last)).withColumn(self.end, (F.struct("_p_", "_k_") == F.col("_last_")).cast("int")).drop("_last_")
            self.temporary.add(self.end)
        text = " ".join(self.body).lower()
        for i, k in enumerate(self.by):
            name = k.lstrip("-")
            part = [b.lstrip("-") for b in self.by[: i + 1]]
            for which in ("first", "last"):
                if f"{which}.{name}" in text:
                    w = self.window(part, which == "last")
                    self.df = self.df.withColumn(f"_{which}_{name}", (F.row_number().over(w) == 1).cast("int"))
                    self.temporary.add(f"_{which}_{name}")

    def one_to_one(self, opened: list) -> None:
        """MERGE without BY pairs the rows by their places; a later dataset's variables replace an earlier one's where it has a row."""
        if not all(order for _, order, _ in opened):
            raise UnsupportedConstruct("MERGE without BY needs sorted datasets")
        out = None
        for i, (df, order, flag) in enumerate(opened):
            df = datastep.numbered(df, shaping.keys(order), "_place_")
            df = df.withColumn(flag.lower(), F.lit(1)) if flag else df
            if out is None:
                out = df
                continue
            both = [c for c in df.columns if c in out.columns and c != "_place_"]
            df = df.withColumnsRenamed({c: f"_later_{c}" for c in both}).withColumn("_here_", F.lit(True))
            out = out.join(df, "_place_", "full")
            out = out.withColumns({c: F.when(F.col("_here_"), F.col(f"_later_{c}")).otherwise(F.col(c)) for c in both}).drop("_here_", *[f"_later_{c}" for c in both])
        flags = [f.lower() for _, _, f in opened if f]
        self.df, self.order = out.fillna(0, flags) if flags else out, ["_place_"]
        self.temporary.add("_place_")

    def merged(self, left, right, by: list[str], opened: list):
        """MERGE with BY: a join where the keys of one side are unique, else the dialect's pairing row by row, which needs both orders."""
        if not merging.duplicate_keys(right, by).limit(1).count() or not merging.duplicate_keys(left, by).limit(1).count():
            return merging.merge(left, right, by)
        if len(opened) > 2 or not all(order for _, order, _ in opened):
            raise UnsupportedConstruct("MERGE with repeated keys on both sides needs two sorted datasets")
        orders = [shaping.keys([k for k in order if k.lstrip("-") not in by] or by) for _, order, _ in opened]
        return merging.merge_sequential(left, right, by, *orders)

    def rest_of_order(self, part: list[str]) -> list[str]:
        rest = [k for k in [*self.by, *self.order] if k.lstrip("-") not in part]
        rest = list(dict.fromkeys(rest))
        if not self.order:
            raise UnsupportedConstruct("an order-sensitive step needs a sorted dataset (PROC SORT before it)")
        return rest or part

    def window(self, part: list[str], backwards: bool = False):
        keys = self.rest_of_order(part)
        if backwards:
            keys = [k[1:] if k.startswith("-") else f"-{k}" for k in keys]
        return Window.partitionBy(*part).orderBy(*shaping.keys(keys))

    # expressions
    def resolve(self, name: str) -> Column:
        name = name.lower()
        if name in self.pending:
            self.flush()
        if name.startswith(("first.", "last.")):
            return F.col(f"_{name.replace('.', '_')}")
        if name == "_n_":
            if "_n_" not in self.df.columns:
                if not self.order:
                    raise UnsupportedConstruct("_N_ needs a sorted dataset")
                self.df = datastep.numbered(self.df, shaping.keys(self.order), "_n_")
                self.temporary.add("_n_")
            return F.col("_n_")
        if name not in {c.lower() for c in self.df.columns}:
            return F.lit(None).cast("double")  # a variable without a value is missing
        return F.col(name)

    def value(self, text: str) -> Value:
        return Parser(text, self.resolve, self.arrays, self.index, self.p.formats, self.lagged, self.df.dtypes if re.search(r"\bof\b", text, re.I) else ()).parse()

    def place(self) -> None:
        """Range partitions of the sorted dataset, written once: what runs along all rows needs them."""
        if "_p_" not in self.df.columns:
            if not self.order:
                raise UnsupportedConstruct("an order-sensitive step needs a sorted dataset (PROC SORT before it)")
            self.df = scans.placed(self.df, shaping.keys(self.order)).rows
            self.temporary |= {"_p_", "_k_"}

    def flush(self) -> None:
        waiting, self.pending = self.pending, {}
        if waiting:
            self.place()
            self.df = scans.carried(self.df, waiting)

    def lagged(self, name: str, inner: Value, text: str) -> Value:
        """LAGn and DIFn: what the call's queue holds, the value n calls before. Calls under a condition count only the rows that reach them; groups don't matter."""
        self.flush()
        self.calls += 1
        made = f"_call_{self.calls}_"
        if name.startswith("put "):  # a format of ranges that are a table
            found = user_format(name[4:], self.p.formats)
            self.df = summaries.format_ranges(self.df.withColumn("_x_", inner.number), "_x_", found["table"], made, found["other"])
            self.df = self.df.withColumn(made, F.coalesce(made, F.col("_x_").cast("string"))).drop("_x_")
            self.temporary.add(made)
            return Value(F.col(made))
        n = int(re.sub(r"\D", "", name) or 1)
        self.place()
        self.df = scans.queued(self.df, made, inner.number, n, F.col(self.current) if self.current else None)
        self.temporary.add(made)
        return Value(F.col(made) if name.startswith("lag") else inner.number - F.col(made))

    # statements
    def run(self) -> None:
        self.read()
        self.block(self.body, None)
        self.flush()
        frames: dict[int, DataFrame] = {}
        explicit = bool(self.outputs)
        for n, (name, options) in enumerate(self.targets):
            if name.lower() == "_null_":
                continue
            if explicit:
                parts = [df.where(g) if g is not None else df for to, df, g in self.outputs if to is None or self.p.key(to) == self.p.key(name)]
                frames[n] = datastep.concatenate(*parts) if parts else self.df.limit(0)
            else:
                frames[n] = self.df
        for n, df in frames.items():
            name, options = self.targets[n]
            df = self.finish(df)
            self.p.bind(name, self.p._output(df, options), [k for k in self.order if k.lstrip("-") in df.columns])

    def finish(self, df: DataFrame) -> DataFrame:
        keep = expanded(self.keep, df.dtypes)
        gone = self.temporary & set(df.columns) - set(keep)
        gone |= {c for c in df.columns if c.startswith("_guard_")}
        df = df.drop(*gone)
        for name, n in self.lengths.items():
            if dict(df.dtypes).get(name) == "string":
                df = df.withColumn(name, F.substring(name, 1, n))
        if self.keep:
            df = df.select(*[c for c in df.columns if c.lower() in keep])
        if self.drop:
            df = df.drop(*expanded(self.drop, df.dtypes))
        names = {a: b for s in self.body if re.match(r"rename\b", s, re.I) for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", s.lower())}
        return df.withColumnsRenamed(names) if names else df

    def block(self, statements: list[str], guard: str | None, first_of: str | None = None) -> None:
        """Runs statements under a guard column; ``first_of`` names the key when the guard is exactly FIRST.key."""
        outside, self.current = self.current, guard
        self.statements(statements, guard, first_of)
        self.current = outside

    def statements(self, statements: list[str], guard: str | None, first_of: str | None) -> None:
        i, last = 0, None  # last: the guard of the IF before, for ELSE
        while i < len(statements):
            s = statements[i]
            low = s.lower()
            if self.returned:  # the rows that met RETURN skip what follows
                guard = self.guard(~F.col(self.returned), guard)
                self.current, self.returned, first_of = guard, None, None
            if re.match(r"select\s*(\(|$)", low):
                stop = self.end_of(statements, i)
                self.cases(s[6:].strip(), statements[i + 1 : stop], guard)
                i, last = stop + 1, None
                continue
            if re.match(r"if\b", low):
                m = re.match(r"if\s+(.*?)\s+then\b\s*(.*)", s, re.I | re.S)
                if not m:
                    self.subset(s[2:].strip(), guard)
                    i += 1
                    continue
                here = re.fullmatch(r"first\.(\w+)", m[1].strip(), re.I)
                g = self.guard(self.value(m[1]).test, guard)
                i = self.branch(statements, i, m[2], g, here[1].lower() if here and guard is None else None)
                last = (self.df_not(g, guard), g)
            elif re.match(r"else\b", low):
                if last is None:
                    raise ValueError("ELSE without IF")
                rest = s[4:].strip()
                m = re.match(r"if\s+(.*?)\s+then\b\s*(.*)", rest, re.I | re.S)
                outer = last[0]
                if m:
                    g = self.guard(self.value(m[1]).test, outer)
                    i = self.branch(statements, i, m[2], g, None)
                    last = (self.df_not(g, outer), g)
                else:
                    i = self.branch(statements, i, rest, outer, None)
                    last = None
            elif re.match(r"do\b", low):
                stop = self.end_of(statements, i)
                self.loop(s, statements[i + 1 : stop], guard)
                i = stop + 1
            else:
                self.simple(s, guard, first_of)
                i += 1

    def guard(self, test: Column, outer: str | None) -> str:
        self.guards += 1
        name = f"_guard_{self.guards}"
        self.df = self.df.withColumn(name, (F.col(outer) & test) if outer else test)
        return name

    def df_not(self, g: str, outer: str | None) -> str:
        return self.guard(~F.col(g), outer)

    def branch(self, statements: list[str], i: int, text: str, g: str, first_of: str | None) -> int:
        if text.strip().lower() == "do":
            stop = self.end_of(statements, i)
            self.block(statements[i + 1 : stop], g, first_of)
            return stop + 1
        self.block([text], g, first_of)
        return i + 1

    @staticmethod
    def end_of(statements: list[str], i: int) -> int:
        level = 0
        for j in range(i, len(statements)):
            s = statements[j].lower()
            level += bool(re.search(r"\bdo$", s) or re.match(r"do\b", s) or re.match(r"select\s*(\(|$)", s) or re.search(r"\b(then|else|when\s*\(.*\)|otherwise)\s+do\b", s))
            level -= s == "end"
            if j > i and not level or j == i and level == 0:
                return j
        raise ValueError("DO without END")

    def cases(self, subject: str, body: list[str], guard: str | None) -> None:
        """SELECT (subject); WHEN (values) statement; OTHERWISE statement; END. Without a subject WHEN holds a condition. A row that no branch takes raises, unless there is OTHERWISE."""
        rest, i = guard, 0
        while i < len(body):
            s = body[i]
            if m := re.match(r"when\s*(?=\()", s, re.I):
                from batchloom.lang.sql import arguments

                values, end = arguments(s, m.end())
                test = " or ".join(f"({subject[1:-1]}) = ({v})" for v in values) if subject else ", ".join(values)
                g = self.guard(self.value(test).test, rest)
                i = self.branch(body, i, s[end:].strip(), g, None)
                rest = self.df_not(g, rest)
            elif re.match(r"otherwise\b", s, re.I):
                i = self.branch(body, i, s[9:].strip(), rest, None) if s[9:].strip() else i + 1
                rest = ""
            else:
                raise UnsupportedConstruct(f"{s} in SELECT")
        if rest:
            self.df = self.df.withColumn(rest, F.when(F.col(rest), F.raise_error(F.lit("no WHEN of a SELECT holds and there is no OTHERWISE")).cast("boolean")).otherwise(F.lit(False)))
            self.df = self.df.where(F.coalesce(~F.col(rest), F.lit(True)))

    def loop(self, head: str, body: list[str], guard: str | None) -> None:
        m = re.fullmatch(r"do\s+(\w+)\s*=\s*(.+?)\s+to\s+(.+?)(?:\s+by\s+(.+?))?", head, re.I | re.S)
        if head.strip().lower() == "do":
            self.block(body, guard)
            return
        bounds = []
        if m and not re.search(r"\b(while|until)\s*\(|\bleave\b|\bcontinue\b", " ".join([head, *body]), re.I):
            for x in (m[2], m[3], m[4] or "1"):
                d = re.fullmatch(r"dim\((\w+)\)", x.strip(), re.I)
                v = len(self.arrays[d[1].lower()]) if d else self.value(x).literal
                if isinstance(v, int):
                    bounds.append(v)
        if len(bounds) < 3:
            self.flush()
            Loop(self, head, body).run(guard)
            return
        a, b, step = bounds
        name = m[1].lower()
        for v in range(a, b + (1 if step > 0 else -1), step):
            self.index[name] = v
            if any(re.search(r"\boutput\b", s, re.I) for s in body):
                self.df = self.df.withColumn(name, F.lit(v))
            self.block(body, guard)
        self.index.pop(name, None)

    def subset(self, text: str, guard: str | None) -> None:
        test = self.value(text).test
        self.flush()
        self.df = self.df.where(test if guard is None else ~F.col(guard) | test)

    def simple(self, s: str, guard: str | None, first_of: str | None) -> None:
        word = re.match(r"\w+", s)
        word = word[0].lower() if word else ""
        if self.hash_statement(s, guard):
            return
        if m := re.fullmatch(r"(\w+)\s*\+\s*(.+)", s, re.S):
            self.accumulate(m[1].lower(), m[2], guard, True)
        elif m := re.fullmatch(r"(\w+(?:\s*[\[{(][^=]*[\]})])?)\s*=\s*(.+)", s, re.S):
            self.assign(m[1].strip(), m[2], guard, first_of)
        elif word in ("set", "merge", "update", "by", "where", "keep", "drop", "rename", "label", "attrib", "informat"):
            pass
        elif word == "format":
            names = s.split()[1:]
            for a, b in zip(names[::2], names[1::2], strict=False):
                if a.lower() in self.df.columns:
                    self.df = datastep.labelled(self.df, **{a.lower(): b})
        elif word == "length":
            for a, b in re.findall(r"(\w+)\s+\$\s*(\d+)", s[6:]):
                self.lengths[a.lower()] = int(b)
        elif word == "retain":
            waiting: list[str] = []  # names that the next value is for
            given = False
            for w in re.findall(r"'[^']*'|\"[^\"]*\"|[^\s,()]+", re.sub(r"\s*-\s*(?=[A-Za-z_])", "-", s[6:])):
                if re.match(r"[A-Za-z_]", w):
                    waiting, given = [*([] if given else waiting), *expanded(w, self.df.dtypes)], False
                    self.retained |= set(waiting)
                else:
                    self.initial |= {n: self.value(w) for n in waiting}
                    given = True
        elif word == "array":
            m = re.match(r"array\s+(\w+)\s*[\[{(]\s*(\d+|\*)\s*[\]})]\s*(\$\s*\d*)?\s*(_temporary_)?\s*([^()]*)(?:\((.*)\))?", s, re.I | re.S)
            names = expanded(m[5], self.df.dtypes)
            values = re.split(r"[,\s]+", m[6].strip()) if m[6] else []
            if m[4] or not names:
                names = [f"_{m[1].lower()}_{k}" if m[4] else f"{m[1].lower()}{k}" for k in range(1, int(m[2] if m[2] != "*" else len(values)) + 1)]
                if m[4]:
                    self.temporary |= set(names)
            self.arrays[m[1].lower()] = names
            for name, v in zip(names, values, strict=False):
                self.df = self.df.withColumn(name, self.value(v).col)
        elif word == "output":
            targets = s.split()[1:] or [None]
            self.flush()
            for t in targets:
                self.outputs.append((t, self.df, F.col(guard) if guard else None))
        elif word == "delete":
            self.flush()
            self.df = self.df.where(~F.col(guard)) if guard else self.df.limit(0)
        elif word == "put":
            self.put(s, guard)
        elif m := re.fullmatch(r"call\s+missing\s*\((.*)\)", s, re.I | re.S):
            for part in m[1].split(","):
                for name in expanded(re.sub(r"^\s*of\b", "", part, flags=re.I), self.df.dtypes):
                    self.store(name, F.lit(None).cast(dict(self.df.dtypes).get(name, "double")), guard)
        elif word == "return" and s.lower().strip() == "return":
            if guard is None:
                raise UnsupportedConstruct("RETURN of every row: what follows would never run")
            self.returned = guard
        elif word == "stop" and s.lower().strip() == "stop":
            self.stop(guard)
        elif word not in ("end", "run", ""):
            raise UnsupportedConstruct(s)

    def stop(self, guard: str | None) -> None:
        """STOP ends the step at the first row of the order that reaches it; this row and those after it are not written."""
        if self.outputs:
            raise UnsupportedConstruct("STOP after OUTPUT")
        self.flush()
        self.place()
        met = F.col(guard).cast("int") if guard else F.lit(1)
        self.df = scans.carried(self.df, {"_stopped_": scans.Carry("sum", F.coalesce(met, F.lit(0)))}).where("_stopped_ = 0").drop("_stopped_")

    def put(self, s: str, guard: str | None) -> None:
        """PUT 'text' name= name format.: a line for each row that reaches it, in the dataset ``_log_`` (statement, line); the program's log keeps the statement."""
        self.p.log.append(s)
        self.flush()
        parts: list[Column] = []
        items = re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_][\w.]*=?\s*(?:\$?\w+\.\d*(?=\s|$))?", s[3:])
        if "".join(items).replace(" ", "") != s[3:].replace(" ", ""):
            raise UnsupportedConstruct(s)
        for x in items:
            x = x.strip()
            if x[0] in "'\"":
                parts.append(F.lit(x[1:-1].replace(x[0] * 2, x[0])))
                continue
            m = re.fullmatch(r"([A-Za-z_][\w.]*?)(=?)\s*(\$?\w+\.\d*)?", x)
            text = self.value(f"put({m[1]}, {m[3]})" if m[3] else m[1]).number
            kind = self.df.select(text.alias("x")).dtypes[0][1]
            if kind != "string":
                text = self.value(f"put({m[1]}, best12.)").number if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") else text.cast("string")
            parts.append(F.concat(F.lit(f"{m[1]}=" if m[2] else ""), F.coalesce(F.trim(text), F.lit("." if kind != "string" else ""))))
        rows = self.df.where(F.col(guard)) if guard else self.df
        lines = rows.select(F.lit(" ".join(s.split())).alias("statement"), F.concat_ws(" ", *parts).alias("line"))
        known = self.p.data.get("_log_")
        last = self.p.last
        self.p.bind("_log_", datastep.concatenate(known.frame, lines) if known else lines)
        self.p.last = last

    def hash_statement(self, s: str, guard: str | None) -> bool:
        """DECLARE HASH with DATASET:, defineKey, defineData, defineDone, and ``rc = h.find()``: a lookup of the first row of each key."""
        if m := re.fullmatch(r"declare\s+hash\s+(\w+)\s*(?:\(\s*dataset\s*:\s*['\"]([\w.]+)['\"]\s*\))?", s, re.I):
            self.hashes[m[1].lower()] = {"dataset": m[2] or "", "key": [], "data": []}
            return True
        m = re.fullmatch(r"(?:(\w+)\s*=\s*)?(\w+)\.(definekey|definedata|definedone|find)\s*\((.*)\)", s, re.I | re.S)
        if not m or m[2].lower() not in self.hashes:
            return False
        table, what = self.hashes[m[2].lower()], m[3].lower()
        names = [x.lower() for x in re.findall(r"['\"](\w+)['\"]", m[4])]
        if what == "definekey":
            table["key"] = names
        elif what == "definedata":
            table["data"] = names
        elif what == "find":
            keys = re.findall(r"key\s*:\s*([^,]+)", m[4], re.I)
            if m[4].strip() and len(keys) != len(table["key"]):
                raise UnsupportedConstruct(f"{s}: as many KEY: as the table has keys")
            d = self.p.dataset(table["dataset"])
            self.flush()
            asked = {f"_key{i}_": self.value(k).number for i, k in enumerate(keys)} or {f"_key{i}_": self.resolve(k) for i, k in enumerate(table["key"])}
            found = [f"_found{i}_" for i in range(len(table["data"]))]
            here = d.frame.select(*[F.col(k).alias(n) for k, n in zip(table["key"], asked, strict=True)], *[F.col(x).alias(n) for x, n in zip(table["data"], found, strict=True)], *[F.col(k.lstrip("-")).alias(f"_by{i}_") for i, k in enumerate(d.order)])
            order = shaping.keys([f"{'-' if k.startswith('-') else ''}_by{i}_" for i, k in enumerate(d.order)])
            df = merging.hash_lookup(self.df.withColumns(asked), here, list(asked), found, order, found="_hash_found_")
            reached = F.coalesce(F.col(guard), F.lit(False)) if guard else F.lit(True)
            hit = reached & (F.col("_hash_found_") == 1)
            kinds = dict(df.dtypes)
            before = {x: F.col(x) if x in self.df.columns else F.lit(None).cast(kinds[n]) for x, n in zip(table["data"], found, strict=True)}
            df = df.withColumns({x: F.when(hit, F.col(n)).otherwise(before[x]) for x, n in zip(table["data"], found, strict=True)})
            if m[1]:
                rc = m[1].lower()
                df = df.withColumn(rc, F.when(reached, F.when(hit, 0).otherwise(1)).otherwise(F.col(rc) if rc in self.df.columns else F.lit(None).cast("int")))
            self.df = df.drop("_hash_found_", *asked, *found)
        return True

    def assign(self, target: str, text: str, guard: str | None, first_of: str | None) -> None:
        m = re.fullmatch(r"(\w+)\s*[\[{(](.*)[\]})]", target, re.S)
        name = self.arrays[m[1].lower()][self.value(m[2]).literal - 1] if m else target.lower()
        if name in self.retained:
            if first_of:
                self.resets[name] = (first_of, self.value(text))
                return
            plain = re.fullmatch(rf"{name}\s*\+\s*(.+)", text, re.I | re.S)
            if plain and not re.search(rf"\b{name}\b", plain[1], re.I):
                self.accumulate(name, plain[1], guard, False)
                return
            if re.search(rf"\b{name}\b", text, re.I):
                self.recur(name, text, guard)
                return
            if guard:
                value, part = self.value(text).number, self.reset_keys(name)
                if part is None:
                    self.waits(name, scans.Carry("last", F.when(F.col(guard), value), self.initial[name].number if name in self.initial else None))
                    return
                self.df = self.df.withColumn("_carried_", F.when(F.col(guard), value))
                w = self.window(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                self.df = self.df.withColumn(name, F.last("_carried_", ignorenulls=True).over(w)).drop("_carried_")
                return
        self.store(name, self.value(text).number, guard)

    def waits(self, name: str, carry: scans.Carry) -> None:
        """A retained variable along all rows; several that don't read each other share one pass."""
        if name in self.pending:
            self.flush()
        self.pending[name] = carry

    def recur(self, name: str, text: str, guard: str | None) -> None:
        """``name = a * name + b`` of retained variables, also inside MAX and MIN with values that don't hold it."""
        gain, add, low, high = _linear(name, text)
        g, b = self.value(gain).number, self.value(add).number
        bounds = [None if x is None else self.value(x).number for x in (low, high)]
        part = self.reset_keys(name)
        start = (self.resets[name][1] if part else self.initial[name] if name in self.initial else Value(F.lit(None).cast("double"))).literal
        if not isinstance(start, (int, float)):
            raise UnsupportedConstruct(f"{name} = {text}: the recurrence needs a constant start")
        if low is not None or high is not None:  # MAX and MIN skip a missing value
            missing = g.isNull() | b.isNull()
            g, b = F.when(missing, 0.0).otherwise(g), F.when(missing, bounds[0] if low is not None else bounds[1]).otherwise(b)
        if guard:
            g, b = F.when(F.col(guard), g).otherwise(1.0), F.when(F.col(guard), b).otherwise(0.0)
            bounds = [None if x is None else F.when(F.col(guard), x) for x in bounds]
        self.flush()
        order = self.rest_of_order(part) if part else self.order
        if not order:
            raise UnsupportedConstruct("an order-sensitive step needs a sorted dataset (PROC SORT before it)")
        self.df = scans.bounded_recurrence(self.df, part or [], shaping.keys(order), g, b, name, float(start), *bounds)

    def reset_keys(self, name: str) -> list[str] | None:
        """BY variables of the group at whose start a variable is set back; None for a variable that runs along all rows."""
        if name not in self.resets:
            return None
        plain = [k.lstrip("-") for k in self.by]
        return plain[: plain.index(self.resets[name][0]) + 1]

    def accumulate(self, name: str, text: str, guard: str | None, skip_missing: bool) -> None:
        x = self.value(text).number
        if guard:
            x = F.when(F.col(guard), x).otherwise(F.lit(0)) if not skip_missing else F.when(F.col(guard), x)
        part = self.reset_keys(name)
        if part is None:
            start = self.initial[name].number if name in self.initial else F.lit(0) if skip_missing else F.lit(None).cast("double")
            self.waits(name, scans.Carry("sum" if skip_missing else "strict", x, start))
            return
        start = self.resets[name][1]
        total = datastep.running_sum(x, self.window(part), skip_missing)
        self.df = self.df.withColumn(name, total if start.literal == 0 else total + start.number)

    def store(self, name: str, value: Column, guard: str | None) -> None:
        if name in self.pending:
            self.flush()
        if guard:
            before = F.col(name) if name in {c.lower() for c in self.df.columns} else F.lit(None)
            value = F.when(F.col(guard), value).otherwise(before)
        if name in self.lengths:
            value = F.substring(value, 1, self.lengths[name])
        self.df = self.df.withColumn(name, value)


def _linear(name: str, text: str) -> tuple[str, str, str | None, str | None]:
    """(gain, add, low, high) of an expression in which ``name`` stands once, as a product's factor in a sum, or of MAX and MIN of such an expression and others."""
    from batchloom.lang.sql import arguments

    text = text.strip()
    holds = re.compile(rf"\b{name}\b", re.I)
    if m := re.match(r"(max|min)\s*(?=\()", text, re.I):
        args, end = arguments(text, m.end())
        inner = [a for a in args if holds.search(a)]
        if end == len(text) and len(inner) == 1 and len(args) == 2:
            gain, add, low, high = _linear(name, inner[0])
            bound = next(a for a in args if a is not inner[0])
            if m[1].lower() == "max" and low is None and high is None:
                return gain, add, bound, None
            if m[1].lower() == "min" and high is None:
                return gain, add, low, bound
        raise UnsupportedConstruct(f"{name} = {text}: not a recurrence that can be composed")
    parts: list[list[str]] = [[]]
    signs, level = ["+"], 0
    for k, w in tokens(text):
        level += {"(": 1, ")": -1}.get(w, 0)
        if k == "op" and w in "+-" and not level and parts[-1] and parts[-1][-1] not in ("*", "/", "**"):
            parts.append([])
            signs.append(w)
        else:
            parts[-1].append(w)
    mine = [i for i, p in enumerate(parts) if any(w.lower() == name for w in p)]
    rest = " ".join(f"{signs[i]} {' '.join(p)}" for i, p in enumerate(parts) if i not in mine) or "0"
    if len(mine) == 1:
        p = parts[mine[0]]
        at = [i for i, w in enumerate(p) if w.lower() == name]
        level = 0
        depth = []
        for w in p:
            level -= w == ")"
            depth.append(level)
            level += w == "("
        i = at[0]
        before_ok = i == 0 or p[i - 1] == "*"
        after_ok = i + 1 == len(p) or p[i + 1] in ("*", "/")
        if len(at) == 1 and depth[i] == 0 and before_ok and after_ok:
            gain = " ".join([*p[:i], "1", *p[i + 1 :]])
            return f"{'-' if signs[mine[0]] == '-' else ''}({gain})", f"0 {rest}" if rest[0] in "+-" else rest, None, None
    raise UnsupportedConstruct(f"{name} = {text}: not a recurrence that can be composed")
