"""Runs programs of the batch dialect: each step becomes a lazy DataFrame, registered under its dataset's name.

WORK datasets live in the program's own table of frames; other libraries are bound by LIBNAME or ``bind``. PROC SORT only records the sort
key: it is what order-sensitive steps (BY groups, RETAIN, FIRSTOBS) order by, and no sort runs before a write. Unsupported constructs raise.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.lang.expressions import Parser, user_format
from batchloom.lang.names import NUMBERS, expanded
from batchloom.lang.sql import run_sql
from batchloom.lang.statements import Macros, UnsupportedConstruct, split_statements, without_comments
from batchloom.operators import datastep, merging, shaping, summaries
from batchloom.functions import dates
from batchloom.sources import Library, contents, export_csv, import_csv
from batchloom.stored import stored


#: Most formats that one CNTLIN= dataset makes; their ranges are not limited.
FORMATS = 1000
#: Most columns that PROC TABULATE makes of a class variable.
TABULATE_COLUMNS = 1000


@dataclass
class Dataset:
    frame: DataFrame
    order: list[str] = field(default_factory=list)


#: Options that each procedure takes besides those it names itself; what only changes the printed page is accepted and has no effect.
_PAGE = {"data", "noprint", "print", "label", "split", "noobs", "n", "headline", "headskip", "nowd", "nowindows", "maxdec", "fw", "format", "style", "missing", "order", "formchar", "details", "position", "varnum", "short", "page", "compress", "nolist"}
OPTIONS = {
    "sort": {"out", "nodupkey", "noduprecs", "nodup", "dupout", "tagsort", "force", "equals", "noequals", "threads", "nothreads", "sortsize"}, "means": {"nway", *(k.lower() for k in summaries.STATISTICS)}, "freq": set(), "transpose": {"out", "prefix", "let", "name"},
    "report": {"out"}, "tabulate": {"out"}, "rank": {"out", "descending", "ties", "groups"}, "standard": {"out", "mean", "std", "replace"}, "append": {"base", "force"}, "import": {"datafile", "out", "dbms", "replace", "delimiter"}, "export": {"outfile", "dbms", "replace", "delimiter"},
    "print": set(), "copy": {"in", "out", "memtype"}, "contents": {"out"}, "datasets": {"lib", "library"}, "univariate": {"out", "normal"}, "format": {"cntlin", "lib", "library"}, "sql": {"outobs", "inobs", "feedback", "stimer"},
}
OPTIONS["summary"] = OPTIONS["means"]


_DATASET = re.compile(r"(?P<name>[A-Za-z_]\w*(?:\.\w+)?)\s*(?:\((?P<options>(?:[^()]|\([^()]*\))*)\))?")


def _datasets(text: str) -> list[tuple[str, str]]:
    return [(m["name"], m["options"] or "") for m in _DATASET.finditer(text)]


def _words(text: str) -> list[str]:
    return text.split()


class Program:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, run_at: str | None = None):
        """``run_at`` is the moment that TODAY() and DATETIME() give, so that a run can be repeated."""
        self.spark, self.macros, self.run_at = spark, Macros(), run_at
        self.data: dict[str, Dataset] = {}
        self.libraries: dict[str, Library] = {}
        self.formats: dict[str, dict] = {}
        self.log: list[str] = []
        self.last = ""
        for name, frame in (tables or {}).items():
            self.bind(name, frame)

    # datasets
    def bind(self, name: str, frame: DataFrame, order: list[str] | None = None) -> None:
        key = self.key(name)
        lib, _, member = key.rpartition(".")
        self.data[key] = Dataset(frame, order or [])
        self.last = key
        if lib and lib != "work" and lib in self.libraries:
            self.libraries[lib].write(frame, member)
            self.data[key] = Dataset(self.libraries[lib].read(member), order or [])

    @staticmethod
    def key(name: str) -> str:
        name = name.lower()
        return name.removeprefix("work.")

    def dataset(self, name: str) -> Dataset:
        key = self.key(name or self.last)
        if key not in self.data:
            lib, _, member = key.rpartition(".")
            if lib not in self.libraries:
                raise ValueError(f"no dataset {name}")
            self.data[key] = Dataset(self.libraries[lib].read(member))
        return self.data[key]

    def known(self, name: str) -> bool:
        """Whether the program has made the dataset or its library holds it from an earlier run."""
        key = self.key(name)
        lib, _, member = key.rpartition(".")
        return key in self.data or (lib in self.libraries and self.libraries[lib].has(member))

    def frame(self, name: str) -> DataFrame:
        return self.dataset(name).frame

    def opened(self, name: str, options: str) -> tuple[DataFrame, list[str], str | None]:
        """Frame, order and IN= variable of ``name(options)``."""
        d = self.dataset(name)
        found = _options(options)
        df = datastep.options(
            d.frame, keep=expanded(found.get("keep", ""), d.frame.dtypes), drop=expanded(found.get("drop", ""), d.frame.dtypes), rename=_renames(found.get("rename", "")),
            obs=int(found["obs"]) if "obs" in found else None, firstobs=int(found["firstobs"]) if "firstobs" in found else None, order=shaping.keys(d.order) if d.order else (),
        )
        if "where" in found:
            df = df.where(self.expression(found["where"], df).test)
        return df, d.order, found.get("in")

    def expression(self, text: str, df: DataFrame, **more):
        known = {c.lower() for c in df.columns}

        def resolve(name: str) -> Column:
            if name.lower() not in known:
                raise ValueError(f"variable {name} is not in the step: {text}")
            return F.col(f"`{name.lower()}`" if name.lower() in df.columns else name)

        return Parser(text, resolve, formats=self.formats, columns=df.dtypes, **more).parse()

    @staticmethod
    def conditions(body: list[str]) -> list[str]:
        """Conditions of a step's WHERE statements: a later one replaces those before it, WHERE ALSO adds to them."""
        out: list[str] = []
        for s in body:
            if m := re.match(r"where\b\s*(also\b|same\s+and\b)?\s*(.*)", s, re.I | re.S):
                out = [*out, m[2]] if m[1] else [m[2]]
        return [x.strip() for x in out if x.strip()]

    # program
    def run(self, text: str) -> Program:
        token = dates.RUN_AT.set(self.run_at)
        try:
            return self.steps(split_statements(self.macros.expand(without_comments(text))))
        finally:
            dates.RUN_AT.reset(token)

    def steps(self, statements: list[str]) -> Program:
        i = 0
        while i < len(statements):
            head = statements[i]
            word = head.split(None, 1)[0].lower()
            stop = i + 1
            if word in ("data", "proc"):
                while stop < len(statements) and statements[stop].lower() not in ("run", "quit") and not re.match(r"(data|proc)\b(?!\s*=)", statements[stop], re.I):
                    stop += 1
                body = statements[i + 1 : stop]
                (self.data_step if word == "data" else self.proc)(head, body)
                if stop < len(statements) and statements[stop].lower() in ("run", "quit"):
                    stop += 1
            elif word == "libname":
                m = re.fullmatch(r"libname\s+(\w+)\s+['\"]?([^'\"]+?)['\"]?", head, re.I)
                place = m[2].strip()
                self.libraries[m[1].lower()] = Library(self.spark, place, catalog="/" not in place)
            elif word not in ("options", "title", "footnote", "run", "quit", "ods"):
                raise UnsupportedConstruct(head)
            i = stop
        return self

    # DATA step
    def data_step(self, head: str, body: list[str]) -> None:
        from batchloom.lang.datastep import DataStep

        DataStep(self, head, body).run()

    # procedures
    def proc(self, head: str, body: list[str]) -> None:
        name = head.split()[1].lower()
        run = getattr(self, f"proc_{name}", None)
        if run is None:
            raise UnsupportedConstruct(f"PROC {name.upper()}")
        rest = re.sub(r"^\s*proc\s+\w+", "", head, flags=re.I)
        for option in _options(rest) if name in OPTIONS else ():
            if option.split("(")[0] not in OPTIONS[name] | _PAGE:
                raise UnsupportedConstruct(f"PROC {name.upper()} {option}")
        run({"data": re.sub(r"^\s*data\s*=", "", rest, flags=re.I)} if name == "delete" else _options(rest), body)

    def proc_sql(self, options: dict[str, str], body: list[str]) -> None:
        for statement in body:
            run_sql(self, statement, {k: int(v) for k, v in options.items() if k in ("outobs", "inobs")})

    def proc_sort(self, o: dict[str, str], body: list[str]) -> None:
        df, order, _ = self._input(o, body, "by")
        by = _by(_statement(body, "by"))
        plain = [k.lstrip("-") for k in by]
        if "nodupkey" in o:
            if not order:
                raise UnsupportedConstruct("NODUPKEY needs a dataset sorted before, to say which row of a key is first")
            if "dupout" in o:
                target = _datasets(o["dupout"])[0]
                self.bind(target[0], self._output(shaping.dupout(df, by, order), target[1]), by)
            df = shaping.nodupkey(df, by, order)
        elif "dupout" in o:
            raise UnsupportedConstruct("DUPOUT= without NODUPKEY")
        elif "noduprecs" in o or "nodup" in o:
            df = shaping.noduprecs(df)
        rest = [k for k in order if k.lstrip("-") not in plain] or [c for c in df.columns if c not in plain]
        name, options = _datasets(o.get("out") or o.get("data") or self.last)[0]
        self.bind(name, self._output(df, options if "out" in o else ""), by + rest)

    def result(self, o: dict[str, str], df: DataFrame, order: list[str]) -> None:
        """Binds a procedure's result to OUT= with its options, or to DATA=."""
        name, options = _datasets(o.get("out") or o.get("data") or self.last)[0]
        self.bind(name, self._output(df, options if "out" in o else ""), order)

    def _input(self, o: dict[str, str], body: list[str], *handled: str):
        """The input of a procedure after its WHERE statement. A statement that the procedure does not handle raises."""
        name, options = _datasets(o.get("data") or self.last)[0]
        df, order, flag = self.opened(name, options)
        for s in body:
            word = re.match(r"\w*", s)[0].lower()
            if word not in (*handled, "where", "format", "label", "title", "footnote", ""):
                raise UnsupportedConstruct(s)
        for where in self.conditions(body):
            df = df.where(self.expression(where, df).test)
        return df, order, flag

    def formatted(self, df: DataFrame, body: list[str], names: list[str]) -> DataFrame:
        """Classification variables with the user formats of a FORMAT statement: groups are those of the formatted values."""
        pending: list[str] = []
        for w in _statement(body, "format").split():
            if "." not in w:
                pending.append(w.lower())
                continue
            if (found := user_format(w, self.formats)) and "table" in found:
                for c in [c for c in pending if c in names]:
                    label = summaries.format_ranges(df, c, found["table"], "_label_", found["other"])
                    df = label.withColumn(c, F.coalesce("_label_", F.col(c).cast("string"))).drop("_label_")
            elif found:
                df = df.withColumns({c: summaries.format_value(c, **found) for c in pending if c in names})
            pending = []
        return df

    def proc_means(self, o: dict[str, str], body: list[str]) -> None:
        df, _, _ = self._input(o, body, "var", "class", "by", "output", "weight", "freq", "types", "ways")
        chosen, _, flags = _statement(body, "class").lower().partition("/")
        if set(flags.split()) - {"missing"}:
            raise UnsupportedConstruct(f"CLASS /{flags}")
        by, cls = [k.lstrip("-") for k in _by(_statement(body, "by"))], expanded(chosen, df.dtypes)
        weight, count = _statement(body, "weight").lower() or None, _statement(body, "freq").lower() or None
        used = {*by, *cls, weight, count}
        var = expanded(_statement(body, "var"), df.dtypes) or [c for c, t in df.dtypes if c not in used and t in NUMBERS]
        df = self.formatted(df, body, cls)
        types = None
        if spec := _statement(body, "types"):
            types = [[] if x.strip("()") == "" else [c for c in cls if c in x.lower().split("*")] for x in spec.split()]
        elif spec := _statement(body, "ways"):
            types = [list(c) for n in spec.split() for c in itertools.combinations(cls, int(n))]
        nway, missing = "nway" in o and types is None, "missing" in o or "missing" in flags
        asked = {k.upper(): None for k in o if k.upper() in summaries.STATISTICS} or dict.fromkeys(("N", "MEAN", "STD", "MIN", "MAX"))
        more = {"nway": nway, "types": types, "missing": missing, "by": by, "weight": weight, "count": count, "type_": "_type_"}
        self.bind("_means_", summaries.means(df, var, asked, cls, freq="_freq_", **more), [*by, *cls])
        for out in [s for s in body if re.match(r"output\b", s, re.I)]:
            target, wanted, names = _output_statement(out, var, df.dtypes)
            result = summaries.named_means(df, wanted, cls, freq=names.get("_freq_", "_freq_"), **more)
            self.bind(target[0], self._output(result, target[1]), [*by, *cls])

    proc_summary = proc_means

    def _output(self, df: DataFrame, options: str) -> DataFrame:
        """Options of an output dataset: WHERE= sees the names before RENAME= and KEEP=."""
        found = _options(options)
        if "where" in found:
            df = df.where(self.expression(found["where"], df).test)
        return datastep.options(df, keep=expanded(found.get("keep", ""), df.dtypes), drop=expanded(found.get("drop", ""), df.dtypes), rename=_renames(found.get("rename", "")))

    def proc_freq(self, o: dict[str, str], body: list[str]) -> None:
        df, _, _ = self._input(o, body, "tables", "table", "weight", "by")
        by, weight = [k.lstrip("-") for k in _by(_statement(body, "by"))], _statement(body, "weight").lower() or None
        for tables in [s for s in body if re.match(r"tables?\b", s, re.I)]:
            spec, _, flags = re.sub(r"^tables?\s+", "", tables, flags=re.I).partition("/")
            f = _options(flags)
            if unknown := set(f) - {"nocum", "nopercent", "norow", "nocol", "nofreq", "noprint", "list", "missing", "sparse", "chisq", "measures", "out"}:
                raise UnsupportedConstruct(f"TABLES / {' '.join(sorted(unknown))}")
            for vars_ in _requests(spec, df.dtypes):
                d = self.formatted(df, body, vars_)
                if len(vars_) == 1:
                    out = summaries.frequencies(d, vars_[0], "nocum" not in f, "missing" in f, by, weight)
                elif "chisq" in f or "measures" in f:
                    if by or weight or len(vars_) > 2:
                        raise UnsupportedConstruct(f"{tables} with BY or WEIGHT")
                    out = summaries.chi_square(d, *vars_) if "chisq" in f else summaries.association(d, *vars_)
                elif len(vars_) == 2:
                    out = summaries.crosstab(d, *vars_, sparse="sparse" in f, percents="nopercent" not in f, by=by, weight=weight)
                else:
                    out = summaries.nway_frequencies(d, vars_, by, weight)
                target = _datasets(f.get("out") or f"freq_{'_'.join(vars_)}")[0]
                self.bind(target[0], self._output(out, target[1]), [*by, *vars_])

    def proc_transpose(self, o: dict[str, str], body: list[str]) -> None:
        df, order, _ = self._input(o, body, "var", "by", "id", "copy")
        if _statement(body, "copy"):
            raise UnsupportedConstruct("COPY in PROC TRANSPOSE")
        var, by, id_ = _words(_statement(body, "var").lower()), [k.lstrip("-") for k in _by(_statement(body, "by"))], _statement(body, "id").lower() or None
        name, options = _datasets(o["out"])[0]
        out = shaping.transpose(df, var, by, id_, prefix=o.get("prefix", ""), name="_name_", order=order or var, let="let" in o)
        self.bind(name, self._output(out, options))

    def proc_format(self, o: dict[str, str], body: list[str]) -> None:
        if "cntlin" in o:
            self.formats_of(self.frame(o["cntlin"]))
        for s in body:
            if not re.match(r"value\b", s, re.I):
                raise UnsupportedConstruct(f"{s} in PROC FORMAT")
        for s in [s for s in body if re.match(r"value\b", s, re.I)]:
            name, _, rest = re.sub(r"^value\s+", "", s, flags=re.I).partition(" ")
            mapping, ranges, other = {}, [], None
            for m in re.finditer(r"((?:'[^']*'|\"[^\"]*\"|[^='\"])+?)\s*=\s*('[^']*'|\"[^\"]*\")", rest):
                left, label = m[1].strip(), m[2][1:-1]
                r = re.fullmatch(r"(low|[-\d.]+)\s*(<?)-(<?)\s*(high|[-\d.]+)", left.replace(" ", ""), re.I)
                if left.lower() == "other":
                    other = label
                elif r:
                    ranges.append((None if r[1].lower() == "low" else float(r[1]), None if r[4].lower() == "high" else float(r[4]), not r[2], not r[3], label))
                else:
                    for v in left.split(","):
                        v = v.strip()
                        mapping[v[1:-1] if v[0] in "'\"" else float(v)] = label
            self.formats[name.lower().strip("$")] = {"mapping": mapping, "ranges": ranges, "other": other}

    def formats_of(self, table: DataFrame) -> None:
        """CNTLIN=: formats of numeric ranges from a dataset (fmtname, start, end, label, and if they are there sexcl, eexcl, hlo). The ranges stay a table; those of one format must not overlap."""
        have = {c.lower() for c in table.columns}
        if not {"fmtname", "start", "label"} <= have or have & {"type"} and table.where("lower(type) = 'c'").limit(1).count():
            raise UnsupportedConstruct("CNTLIN= needs fmtname, start and label, and numeric formats")
        hlo = F.upper(F.coalesce("hlo", F.lit(""))) if "hlo" in have else F.lit("")
        low, high = F.col("start").try_cast("double"), F.coalesce(F.col("end") if "end" in have else F.col("start"), F.col("start")).try_cast("double")
        closed = [F.coalesce(F.upper(c) != "Y", F.lit(True)) if c in have else F.lit(True) for c in ("sexcl", "eexcl")]
        rows = table.select(
            F.lower("fmtname").alias("name"), F.when(~F.contains(hlo, F.lit("L")), low).alias("low"), F.when(~F.contains(hlo, F.lit("H")), high).alias("high"), closed[0].alias("from_"), closed[1].alias("to_"), "label", F.contains(hlo, F.lit("O")).alias("other"),
        )
        names = [r[0] for r in rows.select("name").distinct().limit(FORMATS + 1).collect()]
        if len(names) > FORMATS:
            raise UnsupportedConstruct(f"CNTLIN= with more than {FORMATS} formats")
        for name in names:
            mine = rows.where(F.col("name") == name)
            rest = mine.where("other").select("label").first()
            self.formats[name.strip("$")] = {"table": summaries.range_table(mine.where("not other"), "low", "high", "label", "from_", "to_"), "other": rest[0] if rest else None}

    def proc_report(self, o: dict[str, str], body: list[str]) -> None:
        """The report's rows go to OUT=, or to the dataset ``_report_``."""
        df, _, _ = self._input(o, body, "column", "columns", "define", "break", "rbreak")
        group, analysis = [], {}
        for s in [s for s in body if re.match(r"define\b", s, re.I)]:
            m = re.match(r"define\s+(\w+)\s*/\s*(.*)", s, re.I | re.S)
            use = re.sub(r"(['\"]).*?\1", "", m[2]).lower().split()
            if "group" in use or "order" in use:
                group.append(m[1].lower())
            elif "analysis" in use:
                analysis[m[1].lower()] = next((u.upper() for u in use if u.upper() in summaries.STATISTICS), "SUM")
            elif "computed" in use or "across" in use:
                raise UnsupportedConstruct(s)
        df = self.formatted(df, body, group)
        target = _datasets(o.get("out") or "_report_")[0]
        levels = set()
        for s in [s for s in body if re.match(r"r?break\b", s, re.I)]:
            m = re.fullmatch(r"(?:break\s+(?:before|after)\s+(\w+)|rbreak\s+(?:before|after))\s*(?:/.*)?", s, re.I | re.S)
            if not m or m[1] and m[1].lower() not in group:
                raise UnsupportedConstruct(s)
            levels.add(group.index(m[1].lower()) + 1 if m[1] else 0)
        out = summaries.report(df, group, analysis, order=False, breaks=sorted(levels)) if levels else summaries.report(df, group, analysis, order=False)
        self.bind(target[0], self._output(out, target[1]), group)

    def proc_tabulate(self, o: dict[str, str], body: list[str]) -> None:
        """TABLE row, column*var*statistic: a column for each value of the column class (a class variable has few), and for ALL over all. Any other table is OUT='s list of its crossings."""
        df, _, _ = self._input(o, body, "class", "var", "table", "keylabel")
        cls, var = expanded(_statement(body, "class"), df.dtypes), expanded(_statement(body, "var"), df.dtypes)
        m = re.fullmatch(r"\(?\s*(\w+)(\s+all)?\s*\)?\s*,\s*(\(?\s*(\w+)(\s+all)?\s*\)?)\s*\*\s*(\w+)\s*(?:\*\s*(\w+))?", _statement(body, "table"), re.I)
        if not m or m[2] or m[1].lower() not in cls or m[4].lower() not in cls or m[6].lower() not in var:
            cells = _crossings(_statement(body, "table"), cls, var)
            used = [c for c in cls if any(c in x.classes for x in cells)]
            target = _datasets(o.get("out") or "_tabulate_")[0]
            self.bind(target[0], self._output(summaries.tabulate_cells(self.formatted(df, body, used).dropna(subset=cls), used, cells), target[1]), used)
            return
        df = self.formatted(df, body, cls).dropna(subset=cls)
        values = [r[0] for r in df.select(m[4].lower()).distinct().limit(TABULATE_COLUMNS + 1).collect()]
        if len(values) > TABULATE_COLUMNS:
            raise UnsupportedConstruct(f"PROC TABULATE with more than {TABULATE_COLUMNS} columns")
        out = summaries.tabulate(df, m[1].lower(), m[4].lower(), sorted(values), m[6].lower(), (m[7] or "SUM").upper(), "all" if m[5] else None)
        target = _datasets(o.get("out") or "_tabulate_")[0]
        self.bind(target[0], self._output(out, target[1]), [m[1].lower()])

    def proc_rank(self, o: dict[str, str], body: list[str]) -> None:
        df, order, _ = self._input(o, body, "var", "ranks", "by")
        by = [k.lstrip("-") for k in _by(_statement(body, "by"))]
        var = expanded(_statement(body, "var"), df.dtypes) or [c for c, t in df.dtypes if t in NUMBERS and c not in by]
        names = expanded(_statement(body, "ranks"), df.dtypes)
        for v, n in zip(var, names or var, strict=True):
            df = shaping.rank(df, v, n, by, "descending" in o, o.get("ties", "MEAN"), int(o["groups"]) if "groups" in o else None)
        self.result(o, df, order)

    def proc_standard(self, o: dict[str, str], body: list[str]) -> None:
        df, order, _ = self._input(o, body, "var", "by")
        if "replace" in o:
            raise UnsupportedConstruct("PROC STANDARD REPLACE")
        out = shaping.standardize(df, expanded(_statement(body, "var"), df.dtypes), [k.lstrip("-") for k in _by(_statement(body, "by"))], float(o.get("mean", 0)), float(o.get("std", 1)))
        self.result(o, out, order)

    def proc_append(self, o: dict[str, str], body: list[str]) -> None:
        """Adds rows to BASE=, also to one that its library holds from an earlier run. Where there is none it becomes a copy."""
        new, _, _ = self._input(o, body)
        lib, _, member = self.key(o["base"]).rpartition(".")
        if lib in self.libraries and self.libraries[lib].has(member):
            self.libraries[lib].write(new, member, "append")
            self.data[self.key(o["base"])] = Dataset(self.libraries[lib].read(member))
            return
        self.bind(o["base"], datastep.concatenate(self.frame(o["base"]), new) if self.known(o["base"]) else new)

    def proc_import(self, o: dict[str, str], body: list[str]) -> None:
        path = o["datafile"].strip("'\"")
        self.bind(o["out"], import_csv(self.spark, path, o.get("delimiter", ",").strip("'\""), (_statement(body, "getnames").lstrip("= ") or "yes").lower() != "no"))

    def proc_export(self, o: dict[str, str], body: list[str]) -> None:
        export_csv(self._input(o, body)[0], o["outfile"].strip("'\""), o.get("delimiter", ",").strip("'\""))

    def proc_print(self, o: dict[str, str], body: list[str]) -> None:
        """The rows to be printed are the dataset ``_print_``, the totals of SUM (of each BY group and of all rows) ``_print_sum_``; nothing is collected."""
        df, order, _ = self._input(o, body, "var", "by", "id", "sum")
        var = expanded(_statement(body, "var"), df.dtypes)
        self.log.append(f"PRINT {o.get('data') or self.last}")
        last = self.last
        if totals := expanded(_statement(body, "sum"), df.dtypes):
            by = [k.lstrip("-") for k in _by(_statement(body, "by"))]
            self.bind("_print_sum_", df.rollup(*by).agg(*[F.sum(v).alias(v) for v in totals]) if by else df.agg(*[F.sum(v).alias(v) for v in totals]), by)
        self.bind("_print_", df.select(*var) if var else df, order)
        self.last = last

    def proc_copy(self, o: dict[str, str], body: list[str]) -> None:
        """IN= and OUT= are libraries; SELECT names the members, or all datasets of IN=, those of earlier runs too."""
        source, target = o["in"].lower(), o["out"].lower()
        held = self.libraries[source].members() if source in self.libraries else []
        names = _words(_statement(body, "select").lower()) or sorted({k.split(".")[-1] for k in self.data if (k.rpartition(".")[0] or "work") == source}.union(held))
        gone = _words(_statement(body, "exclude").lower())
        for n in names:
            if n not in gone:
                d = self.dataset(f"{source}.{n}")
                self.bind(f"{target}.{n}", d.frame, d.order)

    def proc_delete(self, o: dict[str, str], body: list[str]) -> None:
        """Forgets datasets; a permanent one is deleted from its library."""
        for n in _words(o["data"].lower()):
            self.forget(n)

    def forget(self, name: str) -> None:
        key = self.key(name)
        self.data.pop(key, None)
        lib, _, member = key.rpartition(".")
        if lib in self.libraries:
            self.libraries[lib].delete(member)

    def proc_contents(self, o: dict[str, str], body: list[str]) -> None:
        self.bind(o.get("out", "_contents_"), contents(self._input(o, body)[0]))

    def proc_datasets(self, o: dict[str, str], body: list[str]) -> None:
        lib = o.get("lib") or o.get("library")
        place = f"{lib}." if lib else ""
        for s in body:
            word, *names = s.replace("/", " ").split()
            word = word.lower()
            if word == "delete":
                for n in names:
                    self.forget(place + n)
            elif word in ("change", "exchange"):
                pairs = re.findall(r"(\w+)\s*=\s*(\w+)", s)
                if not pairs or re.sub(r"(\w+)\s*=\s*(\w+)", "", s).split() != [s.split()[0]]:
                    raise UnsupportedConstruct(s)
                for a, b in pairs:
                    self.renamed(place + a, place + b, word == "exchange")
            elif word == "age":  # each dataset takes the next one's name; the last is deleted
                self.forget(place + names[-1])
                for a, b in reversed(list(itertools.pairwise(names))):
                    self.renamed(place + a, place + b)
            elif word == "modify":
                modified = place + names[0]
            elif word == "index" and names[0].lower() == "create":
                self.indexed(modified, s)
            elif word in ("label", "format", "informat"):
                self.log.append(s)  # attributes of the printed page
            else:
                raise UnsupportedConstruct(s)

    def renamed(self, a: str, b: str, exchange: bool = False) -> None:
        one, other = self.dataset(a), self.dataset(b) if exchange else None
        if not exchange and self.known(b):
            raise ValueError(f"there is already a dataset {b}")
        frames = [Dataset(stored(d.frame), d.order) if d and self.key(a).rpartition(".")[0] else d for d in (one, other)]  # a library's files move
        self.forget(a)
        if other:
            self.forget(b)
            self.bind(a, frames[1].frame, frames[1].order)
        self.bind(b, frames[0].frame, frames[0].order)

    def indexed(self, name: str, statement: str) -> None:
        """INDEX CREATE column, or name=(columns): of a library's dataset an index by its first column; a WORK dataset is a plan and has no files to index."""
        lib, _, member = self.key(name).rpartition(".")
        m = re.fullmatch(r"index\s+create\s+(\w+)\s*(?:=\s*\(([^()]*)\))?\s*(?:/.*)?", statement, re.I)
        if not m:
            raise UnsupportedConstruct(statement)
        if lib in self.libraries and not self.libraries[lib].catalog:
            self.libraries[lib].versions(member).create_index((m[2].split()[0] if m[2] else m[1]).lower())
        self.log.append(statement)

    def proc_univariate(self, o: dict[str, str], body: list[str]) -> None:
        df, _, _ = self._input(o, body, "var", "class", "output", "by")
        by = [*[k.lstrip("-") for k in _by(_statement(body, "by"))], *expanded(_statement(body, "class"), df.dtypes)]
        var = expanded(_statement(body, "var"), df.dtypes) or [c for c, t in df.dtypes if c not in by and t in NUMBERS]
        self.bind(o.get("out", "_univariate_"), summaries.univariate(df, var if len(var) > 1 else var[0], by))
        for s in [s for s in body if re.match(r"output\b", s, re.I)]:
            target, wanted, _ = _output_statement(s, var, df.dtypes)
            self.bind(target[0], self._output(summaries.named_means(df, wanted, [], freq=None, type_=None, by=by), target[1]), by)


def _crossings(text: str, cls: list[str], var: list[str]) -> list[summaries.Cell]:
    """Cells of a TABLE statement: dimensions by commas; in each, blanks concatenate, ``*`` crosses, parentheses group; ALL stands for no class variable."""
    text = re.sub(r"=\s*(?:'[^']*'|\"[^\"]*\"|[\w.]+)", " ", text.partition("/")[0].lower())
    text = re.sub(r"\*\s*f\b", "", text)
    words = re.findall(r"\w+|[*(),]", text)
    if "".join(words) != re.sub(r"\s", "", text):
        raise UnsupportedConstruct(f"TABLE {text}")
    i = 0

    def items() -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        while i < len(words) and words[i] not in ",)":
            out += crossed()
        return out

    def crossed() -> list[tuple[str, ...]]:
        nonlocal i
        out = one()
        while i < len(words) and words[i] == "*":
            i += 1
            out = [a + b for a, b in itertools.product(out, one())]
        return out

    def one() -> list[tuple[str, ...]]:
        nonlocal i
        word = words[i] if i < len(words) else ""
        i += 1
        if word == "(":
            out = items()
            if i >= len(words) or words[i] != ")":
                raise UnsupportedConstruct(f"TABLE {text}")
            i += 1
            return out
        if word in cls or word in var or word == "all" or word.upper() in summaries.STATISTICS or word.upper() in summaries.PERCENTS:
            return [(word,)]
        raise UnsupportedConstruct(f"TABLE {text}: {word}")

    dimensions = [items()]
    while i < len(words) and words[i] == ",":
        i += 1
        dimensions.append(items())
    if i < len(words) or len(dimensions) > 3:
        raise UnsupportedConstruct(f"TABLE {text}")
    cells = []
    for parts in itertools.product(*dimensions):
        flat = [w for p in parts for w in p]
        classes = tuple(c for c in cls if c in flat)
        xs, stats = [w for w in flat if w in var], [w.upper() for w in flat if w not in var and w not in cls and w != "all"]
        if len(xs) > 1 or len(stats) > 1:
            raise UnsupportedConstruct(f"TABLE {text}: two variables or statistics are crossed")
        stat = stats[0] if stats else "SUM" if xs else "N"
        if not xs and stat not in ("N", "PCTN", "ROWPCTN", "COLPCTN"):
            raise UnsupportedConstruct(f"TABLE {text}: {stat} without a variable")
        rows = {w for p in parts[:-1] for w in p}
        of = None
        if stat in summaries.PERCENTS:
            of = () if stat.startswith("PCT") else tuple(c for c in classes if (c in rows) == stat.startswith("ROW"))
        cells.append(summaries.Cell(classes, xs[0] if xs and stat not in ("PCTN", "ROWPCTN", "COLPCTN") else None, stat, of))
    return list(dict.fromkeys(cells))


def _requests(spec: str, columns: list[tuple[str, str]]) -> list[list[str]]:
    """TABLES requests: ``a b*c a*(b c)``, parentheses multiplied out."""
    text = re.sub(r"\s*\*\s*", "*", spec.strip().lower())
    out: list[list[str]] = []
    while text:
        m = re.match(r"(?:\([^()]*\)|[\w:]+(?:--?\w+)?)(?:\*(?:\([^()]*\)|\w+))*(?=\s|$)", text)
        if not m:
            raise UnsupportedConstruct(f"TABLES {spec}")
        factors = [expanded(f.strip("()"), columns) for f in m[0].split("*")]
        out += [list(x) for x in itertools.product(*factors)]
        text = text[m.end() :].lstrip()
    return out


def _output_statement(statement: str, var: list[str], columns: list[tuple[str, str]]) -> tuple[tuple[str, str], list[tuple[str, str, str]], dict[str, str]]:
    """(OUT= dataset, statistics (keyword, variable, name), other names) of ``OUTPUT out=d stat(vars)=names .. / autoname``."""
    text, _, flags = re.sub(r"^output\s*", "", statement, flags=re.I).partition("/")
    flags_ = set(flags.lower().split())
    if flags_ - {"autoname", "autolabel", "noinherit", "inherit"}:
        raise UnsupportedConstruct(statement)
    target, wanted, more, i = ("_output_", ""), [], {}, 0
    text = text.strip()
    while i < len(text):
        m = re.compile(r"(\w+)\s*(?:\(([^()]*)\))?\s*=\s*").match(text, i)
        if not m:
            raise UnsupportedConstruct(statement)
        word, i = m[1].lower(), m.end()
        if word == "out":
            d = _DATASET.match(text, i)
            target, i = (d["name"], d["options"] or ""), d.end()
        else:
            n = re.compile(r"(?:[A-Za-z_]\w*(?:-\w+)?\b(?!\s*[=(])\s*)*").match(text, i)
            names, i = expanded(n[0], columns), n.end()
            if word == "_freq_":
                more[word] = names[0]
            elif word.upper() in summaries.STATISTICS or word.upper() == "SUMWGT":
                of = expanded(m[2], columns) if m[2] is not None else var
                if len(names) > len(of):
                    raise UnsupportedConstruct(f"{statement}: more names than variables")
                names = names or [f"{v}_{word}" if "autoname" in flags_ else v for v in of]
                wanted += [(word.upper(), v, name) for v, name in zip(of, names, strict=False)]
            else:
                raise UnsupportedConstruct(f"{statement}: {word}")
        i += len(text[i:]) - len(text[i:].lstrip())
    made = [n for _, _, n in wanted]
    if twice := {n for n in made if made.count(n) > 1}:
        raise UnsupportedConstruct(f"{statement}: two statistics are called {', '.join(sorted(twice))}")
    return target, wanted, more


def _options(text: str) -> dict[str, str]:
    """name=value pairs and flags; a value is a word, a quoted text, a parenthesis, or words up to the next name=."""
    out: dict[str, str] = {}
    pattern = re.compile(r"(?P<k>[A-Za-z_]\w*(?:\([^()]*\))?)\s*(?P<eq>=)?\s*")
    i = 0
    while i < len(text):
        m = pattern.match(text, i)
        if not m:
            i += 1
            continue
        i = m.end()
        key = m["k"].lower()
        if not m["eq"]:
            out[key] = ""
            continue
        if i < len(text) and text[i] == "(":
            level, j = 0, i
            while True:
                level += {"(": 1, ")": -1}.get(text[j], 0)
                j += 1
                if not level:
                    break
            out[key], i = text[i + 1 : j - 1], j
            continue
        v = re.compile(r"'[^']*'|\"[^\"]*\"|(?:\.?[-\w.*$:]+(?:\s*\((?:[^()]|\([^()]*\))*\))?)(?:\s+[-\w*.:]+(?!\s*=|[\w:-]|\())*").match(text, i)
        value = v[0] if v else ""
        if key not in ("keep", "drop") and key.upper() not in summaries.STATISTICS:
            first = re.match(r"'[^']*'|\"[^\"]*\"|[-\w.*$]+(?:\s*\((?:[^()]|\([^()]*\))*\))?", value)
            value = first[0] if first else ""
        out[key], i = value.strip(), i + len(value)
    return out


def _renames(text: str) -> dict[str, str]:
    return {a.lower(): b.lower() for a, b in re.findall(r"(\w+)\s*=\s*(\w+)", text)}


def _statement(body: list[str], word: str) -> str:
    for s in body:
        m = re.match(rf"{word}\b\s*(.*)", s, re.I | re.S)
        if m:
            return m[1].strip()
    return ""


def _by(text: str) -> list[str]:
    """Sort keys; DESCENDING applies to the next name."""
    out, down = [], False
    for w in text.lower().split():
        if w == "descending":
            down = True
        elif w != "notsorted":
            out.append(f"-{w}" if down else w)
            down = False
    return out
