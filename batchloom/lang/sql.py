"""PROC SQL statements: the dialect's text is rewritten to Spark SQL and run over the program's datasets."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom import functions
from batchloom.lang.expressions import user_format
from batchloom.lang.statements import UnsupportedConstruct
from batchloom.operators import datastep, merging, shaping, summaries
from batchloom.operators.datastep import concatenate

if TYPE_CHECKING:
    from batchloom.lang.program import Program

#: Months of date literals.
_MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
#: Aggregates of one argument under their dialect names; with more arguments the names are functions of a row.
_AGGREGATES = {"mean": "avg({0})", "avg": "avg({0})", "sum": "sum({0})", "min": "min({0})", "max": "max({0})", "std": "stddev_samp({0})", "var": "var_samp({0})", "n": "count({0})", "freq": "count({0})", "nmiss": "count(CASE WHEN ({0}) IS NULL THEN 1 END)", "range": "(max({0}) - min({0}))", "uss": "sum(({0}) * ({0}))", "css": "(var_pop({0}) * count({0}))", "count": "count({0})"}
#: Names that mean the same in Spark and take part in its grammar.
_PLAIN = {"coalesce", "count", "cast", "in", "and", "or", "not", "case", "when", "then", "else", "on", "where", "values", "exists", "select", "from", "as", "over", "union", "nullif", "distinct"}


def arguments(text: str, i: int) -> tuple[list[str], int]:
    """Arguments of the parenthesis that opens at i, and the place after it."""
    out, level, start, quote = [], 0, i + 1, ""
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            level += 1
        elif c == ")":
            level -= 1
            if not level:
                last = text[start:j].strip()
                return [*out, last] if last or out else [], j + 1
        elif c == "," and level == 1:
            out.append(text[start:j].strip())
            start = j + 1
    raise UnsupportedConstruct("a parenthesis does not close")


def _function(name: str, a: list[str], program: Program) -> str | None:
    """A call as Spark SQL: aggregates by their names, all other dialect functions through the same columns as in DATA steps."""
    if name == "monotonic":
        return "_monotonic_"
    if name in _PLAIN and not (name == "count"):
        return None
    if name in _AGGREGATES and len(a) == 1:
        if name == "sum" and re.search(r"[^<>]=|<|>", a[0]) and "case" not in a[0].lower():
            return f"sum(cast({a[0]} as int))"
        return _AGGREGATES[name].format(*a)
    if name.upper() not in functions.FUNCTIONS and name != "put":
        return None
    values: list[object] = []
    for i, x in enumerate(a):
        if name in ("put", "input") and i == 1:
            values.append(x.replace(" ", ""))
        elif re.fullmatch(r"'(?:\\'|[^'])*'", x):
            values.append(x[1:-1].replace("\\u0027", "'").replace("\\u005C", "\\"))
        elif re.fullmatch(r"-?\d+", x):
            values.append(int(x))
        elif re.fullmatch(r"-?\d*\.\d+", x):
            values.append(float(x))
        else:
            values.append(F.col(f"_a{i}_"))
    try:
        found = user_format(values[1], program.formats) if name == "put" else None
        if found and "table" in found:
            raise UnsupportedConstruct(f"PUT with the format {values[1]} in SQL: its ranges are a table")
        column = summaries.format_value(values[0] if isinstance(values[0], Column) else F.lit(values[0]), **found) if found else functions.call(name, *values)
    except TypeError as e:
        raise UnsupportedConstruct(f"{name.upper()}({', '.join(a)}): {e}") from None
    sql = program.spark._jsparkSession.expression(column._jc).sql()
    sql = re.sub(r"lambdafunction\((.*?), (x_\d+)\)", r"\2 -> \1", sql) if sql.count("lambdafunction") == 1 else sql
    if "lambdafunction" in sql:
        raise UnsupportedConstruct(f"{name.upper()}({', '.join(a)}) in SQL")
    sql = re.sub(r"(?<![\w`])(or|and)\(", r"`\1`(", sql)
    return re.sub(r"_a(\d+)_", lambda m: f"({a[int(m[1])]})", sql)


_WORDS = {"and", "or", "not", "when", "then", "else", "where", "on", "having", "between", "in", "is", "null", "select", "case", "end", "as", "by", "like", "exists", "any", "all", "from", "distinct"}
#: An operand of a comparison: names, numbers, held literals and calls without inner parentheses, and sums and products of them.
_ATOM = r"(?:[A-Za-z_]\w*(?:\.\w+)?(?:\([^()]*\))?|\d+(?:\.\d+)?|\.\d+|\x00\d+\x00)"
_OPERAND = rf"{_ATOM}(?:\s*[-+*/]\s*{_ATOM})*"


def with_missing(text: str) -> str:
    """Comparisons with the dialect's rule: a missing value is less than every number, equal to itself and unequal to all others; it is in no list."""

    def constant(x: str) -> bool:
        return not re.search(r"[A-Za-z_]", re.sub(r"\x00\d+\x00", "", x))

    def test(m: re.Match) -> str:
        a, sign, b = m["a"], m["sign"], m["b"]
        if any(w.lower() in _WORDS for w in re.findall(r"[A-Za-z_]\w*", f"{a} {b}")) or constant(a) and constant(b):
            return m[0]
        if sign in (">", ">="):
            a, b, sign = b, a, sign.replace(">", "<")
        whole = f"{a} {sign} {b}"
        if sign in ("<>", "="):
            return f"(NOT ({a} <=> {b}))" if sign == "<>" else f"({a} <=> {b})"
        if constant(a):
            return f"coalesce({whole}, false)"
        one, other = (x if re.fullmatch(r"[\w.]+", x) else f"({x})" for x in (a, b))
        return f"coalesce({whole}, {one} IS NULL{'' if constant(b) or sign == '<=' else f' AND {other} IS NOT NULL'})"

    pattern = rf"(?<![\w.'+*/\-)`\x00])(?P<a>{_OPERAND})\s*(?P<sign><=|>=|<>|<|>|=)\s*(?P<b>{_OPERAND})(?![\w.('`]|\s*[-+*/(])(?<!\bdate)(?<!\btimestamp)"
    text = re.sub(pattern, test, text, flags=re.I)
    return re.sub(rf"(?<![\w.'+*/\-)`\x00])({_OPERAND})\s+not\s+in\s*(\((?!\s*select\b)[^()]*\))", lambda m: f"coalesce({m[1]} NOT IN {m[2]}, true)", text, flags=re.I)


def rewrite(text: str, program: Program) -> str:
    """Dialect SQL as Spark SQL."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    def literal(m: re.Match) -> str:
        body, kind = m[2], (m[3] or "").lower()
        if kind:
            d = re.fullmatch(r"(\d{1,2})([A-Za-z]{3})(\d{4})(?::(.+))?", body.strip())
            day = f"{d[3]}-{_MONTHS[d[2].upper()]:02d}-{int(d[1]):02d}"
            return hold(f"DATE'{day}'" if kind == "d" else f"TIMESTAMP'{day} {d[4]}'")
        return hold("'" + body.replace("\\", "\\u005C").replace("'", "\\u0027") + "'")  # the dialect has no escapes

    text = re.sub(r"(['\"])((?:(?!\1).)*)\1(dt|d)?(?!\w)", literal, text + " ", flags=re.I | re.S) if "'" in text or '"' in text else text
    text = re.sub(r"\bcalculated\s+", "", text, flags=re.I)
    text = re.sub(rf"({_ATOM})\s+(not\s+)?(?:contains\b|\?)\s*(\x00\d+\x00)", lambda m: f"({'NOT ' if m[2] else ''}contains(coalesce({m[1]}, ''), {m[3]}))", text, flags=re.I)
    text = re.sub(r"(\^=|~=|<>|\bne\b)\s*\.(?![\w.])", " IS NOT NULL", text, flags=re.I)
    text = re.sub(r"(=|\beq\b)\s*\.(?![\w.])", " IS NULL", text, flags=re.I)
    for word, sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
        text = re.sub(rf"(?<![\w.]){word}(?![\w(.])", sign, text, flags=re.I)
    text = re.sub(r"\^=|~=", "<>", text)
    text = re.sub(r"\bformat\s*=\s*\$?\w+\.\d*", "", text, flags=re.I)

    def blank(m: re.Match) -> str:
        return f"nullif(trim({m[1]}), '') IS {'NULL' if m[2] == '=' else 'NOT NULL'}" if not held[int(m[3])].strip("'").strip() else m[0]

    text = re.sub(r"([\w.]+)\s*(=|<>)\s*\x00(\d+)\x00", blank, text)
    text = with_missing(text)
    text = re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], text)
    out, i = [], 0
    call = re.compile(r"'(?:\\'|[^'])*'|\b([A-Za-z_]\w*)\s*\(")
    while m := call.search(text, i):
        if not m[1]:
            out.append(text[i : m.end()])
            i = m.end()
            continue
        args, end = arguments(text, m.end() - 1)
        done = [rewrite_calls(a, program) for a in args]
        made = _function(m[1].lower(), done, program)
        out.append(text[i : m.start()] + (made if made is not None else f"{m[1]}({', '.join(done)})"))
        i = end
    return "".join(out) + text[i:]


def rewrite_calls(text: str, program: Program) -> str:
    """Function calls inside an argument."""
    m = re.search(r"\b([A-Za-z_]\w*)\s*\(", text)
    if not m:
        return text
    args, end = arguments(text, m.end() - 1)
    done = [rewrite_calls(a, program) for a in args]
    made = _function(m[1].lower(), done, program)
    return text[: m.start()] + (made if made is not None else f"{m[1]}({', '.join(done)})") + rewrite_calls(text[end:], program)


_FROM = re.compile(r"\b(from|join|into\s+table)\s+([A-Za-z_]\w*(?:\.\w+)?)((?:\s+(?:as\s+)?(?!where\b|on\b|group\b|order\b|left\b|right\b|inner\b|full\b|cross\b|join\b|having\b|union\b|limit\b)\w+)?(?:\s*,\s*[A-Za-z_]\w*(?:\.\w+)?(?:\s+(?:as\s+)?(?!where\b|group\b|order\b)\w+)?)*)", re.I)


def _clauses(text: str) -> dict[str, str]:
    """Top-level clauses of one SELECT: select, from, where, group by, having, order by."""
    found, level, quote, last, start = {}, 0, "", "select", 6
    words = re.compile(r"(from|where|group\s+by|having|order\s+by)\b", re.I)
    i = 6
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            level += 1 if c == "(" else -1
        elif not level and not text[i - 1].isalnum() and text[i - 1] not in "_." and (m := words.match(text, i)):
            found[last] = text[start:i].strip()
            last, start, i = re.sub(r"\s+", " ", m[1].lower()), m.end(), m.end() - 1
        i += 1
    found[last] = text[start:].strip()
    return found


_CALL = re.compile(r"\b(mean|avg|sum|min|max|std|var|n|nmiss|range|count|uss|css)\s*\(", re.I)


def _aggregates(text: str) -> list[tuple[int, int]]:
    """Places of aggregate calls (of one argument)."""
    out, i = [], 0
    while m := _CALL.search(text, i):
        args, end = arguments(text, m.end() - 1)
        if len(args) == 1 and not re.match(r"\s*over\b", text[end:], re.I):
            out.append((m.start(), end))
            i = end
        else:
            i = m.end()
    return out


def _over(text: str, keys: str) -> str:
    for a, b in reversed(_aggregates(text)):
        text = f"{text[:b]} OVER (PARTITION BY {keys})" + text[b:] if keys else f"{text[:b]} OVER (PARTITION BY 1)" + text[b:]
    return text


def remerged(text: str) -> str:
    """A SELECT that mixes aggregates with columns outside GROUP BY gets the group's statistics beside every row: aggregates become windows."""
    if re.search(r"\bunion\b|\bdistinct\b|\bintersect\b|\bexcept\b", text, re.I):
        return text
    c = _clauses(text.strip())
    items = arguments(f"({c['select']})", 0)[0]
    keys = {re.sub(r"\s+", " ", k.strip().lower().rsplit(".", 1)[-1]) for k in c.get("group by", "").split(",") if k.strip()}
    keys = {re.sub(r"^calculated ", "", k) for k in keys}
    named = [(re.sub(r"\s+as\s+\w+$", "", x, flags=re.I).strip(), m[1].lower() if (m := re.search(r"\s+as\s+(\w+)$", x, re.I)) else "") for x in items]
    some = any(_aggregates(x) for x, _ in named) or bool(_aggregates(c.get("having", "")))

    def free(x: str, alias: str) -> bool:
        outside = x
        for a, b in reversed(_aggregates(x)):
            outside = outside[:a] + outside[b:]
        outside = re.sub(r"'[^']*'|\"[^\"]*\"", "", outside)
        names = {w.lower() for w in re.findall(r"\b[A-Za-z_]\w*\b(?!\s*[.(])", outside)} - _WORDS - {"calculated"}
        aliases = {n for _, n in named}
        return "*" in outside and not names or alias not in keys and bool(names - keys - (aliases if "calculated" in x.lower() else set()))

    if not some or not any(free(x, a) for x, a in named):
        return text
    by = c.get("group by", "")
    if not by:  # one row of statistics, not a window over all rows
        source = f"from {c['from']}" + (f" where {c['where']}" if "where" in c else "")

        def scalar(x: str) -> str:
            for a, b in reversed(_aggregates(x)):
                x = f"{x[:a]}(select {x[a:b]} {source}){x[b:]}"
            return x

        kept = f" where ({c['where']}) and ({scalar(c['having'])})" if "having" in c and "where" in c else f" where {scalar(c['having'])}" if "having" in c else f" where {c['where']}" if "where" in c else ""
        return f"select {', '.join(map(scalar, items))} from {c['from']}{kept}" + (f" order by {c['order by']}" if "order by" in c else "")
    made = ", ".join(_over(x, by) for x in items)
    out = f"select {made}" + (f", ({_over(c['having'], by)}) as _having_" if "having" in c else "") + f" from {c['from']}" + (f" where {c['where']}" if "where" in c else "")
    if "having" in c:
        out = f"select * except (_having_) from ({out}) _remerged_ where _having_"
    return out + (f" order by {c['order by']}" if "order by" in c else "")


def with_calculated(text: str) -> str:
    """CALCULATED names in WHERE become their expressions."""
    c = _clauses(text.strip())
    if not re.search(r"\bcalculated\b", c.get("where", ""), re.I):
        return text
    named = {m[2].lower(): m[1].strip() for x in arguments(f"({c['select']})", 0)[0] if (m := re.fullmatch(r"(.*?)\s+as\s+(\w+)", x.strip(), re.I | re.S))}
    where = c["where"]
    for _ in range(len(named) + 1):
        where = re.sub(r"\bcalculated\s+(\w+)", lambda m: f"({named[m[1].lower()]})" if m[1].lower() in named else m[0], where, flags=re.I)
    return text.replace(c["where"], where, 1)


def corresponding(parts: list[DataFrame], kind: str, every: bool) -> DataFrame:
    """UNION, EXCEPT and INTERSECT CORR: by the columns that both sides have."""
    out = parts[0]
    for other in parts[1:]:
        common = [c for c in out.columns if c.lower() in {x.lower() for x in other.columns}]
        a, b = out.select(*common), other.select(*common)
        if kind == "union":
            out = a.unionByName(b) if every else a.unionByName(b).distinct()
        elif kind == "except":
            out = a.exceptAll(b) if every else a.subtract(b)
        else:
            out = a.intersectAll(b) if every else a.intersect(b)
    return out


def select(program: Program, text: str, inobs: int | None = None) -> DataFrame:
    """The frame of a SELECT."""
    for kind in ("union", "except", "intersect"):
        for every in (True, False):
            found = re.split(rf"(?<!outer )\b{kind}\s+{'(?:all|corr(?:esponding)?)' if every else ''}{chr(92) + 's+' if every else ''}{'(?:all|corr(?:esponding)?)' if every else 'corr(?:esponding)?'}\b", text, flags=re.I)
            if len(found) > 1:
                return corresponding([select(program, p, inobs) for p in found], kind, every)
    text = with_calculated(text)
    parts = re.split(r"\bouter\s+union\s+corr(?:esponding)?\b", text, flags=re.I)
    if len(parts) > 1:
        return merging.outer_union_corr(*[select(program, p, inobs) for p in parts])
    text = remerged(text)
    frames: dict[str, DataFrame] = {}
    monotonic = bool(re.search(r"\bmonotonic\s*\(", text, re.I))

    def one(name: str):
        d = program.dataset(name)
        alias = "t_" + re.sub(r"\W", "_", program.key(name))
        frame = d.frame
        if inobs is not None or monotonic:
            if not d.order:
                raise UnsupportedConstruct(f"{'MONOTONIC()' if monotonic else 'INOBS='} needs a sorted dataset, not {name}")
            frame = frame.orderBy(*shaping.keys(d.order)).limit(inobs) if inobs is not None else frame
        if monotonic:
            if frames:
                raise UnsupportedConstruct("MONOTONIC() over a join; store the join first")
            c = _clauses(text.strip())
            frame = frame.where(rewrite(c["where"], program)) if "where" in c else frame  # the rows that pass are numbered
            frame = datastep.numbered(frame, shaping.keys(d.order), "_monotonic_")
        frames[alias] = frame
        short = name.rsplit(".", 1)[-1]
        return "{" + alias + "}", short

    def source(m: re.Match) -> str:
        out = []
        for part in (m[2] + m[3]).split(","):
            words = part.split()
            ref, short = one(words[0])
            out.append(f"{ref} {' '.join(words[1:]) or short}")
        return f"{m[1]} {', '.join(out)}"

    made = _FROM.sub(source, re.sub(r"[{}]", lambda m: m[0] * 2, text))
    conf = program.spark.conf
    ansi = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")  # division by zero and impossible dates are missing; the plan keeps what held when it was made
    try:
        df = program.spark.sql(rewrite(made, program), **frames)
    finally:
        conf.set("spark.sql.ansi.enabled", ansi)
    stored_ = {c.lower() for f in frames.values() for c, kind in f.dtypes if kind == "boolean"}
    numbers = {c: F.col(f"`{c}`").cast("int") for c, kind in df.dtypes if kind == "boolean" and c.lower() not in stored_}
    return df.withColumns(numbers) if numbers else df  # a condition is 0 or 1


def _sort_keys(text: str, columns: list[str]) -> list[str]:
    """ORDER BY items as sort keys; a number is the place of a column."""
    out = []
    for k in text.split(","):
        name = k.split()[0].rsplit(".", 1)[-1].lower()
        name = k.split()[1].lower() if name == "calculated" else name
        out.append(("-" if re.search(r"\bdesc", k, re.I) else "") + (columns[int(name) - 1].lower() if name.isdigit() else name))
    return out


def ordered(program: Program, text: str, limits: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """A SELECT's frame without its final sort, and the sort key; OUTOBS= keeps the first rows by it (or by the dataset's order)."""
    keys = re.search(r"\border\s+by\s+([\w.,\s]+)$", text, re.I)
    df = select(program, text[: keys.start()] if keys else text, limits.get("inobs"))
    order = _sort_keys(keys[1], df.columns) if keys else []
    missing = [k for k in order if k.lstrip("-") not in {c.lower() for c in df.columns}]
    if keys and missing:  # sorted by columns that are not selected
        if "outobs" in limits:
            df = select(program, text, limits.get("inobs")).limit(limits["outobs"])
        return df, [k for k in order if k not in missing]
    if "outobs" in limits:
        by = order or [k for m in re.finditer(r"\bfrom\s+([\w.]+)", text, re.I) for k in program.dataset(m[1]).order if k.lstrip("-") in df.columns]
        if not by:
            raise UnsupportedConstruct("OUTOBS= needs ORDER BY or a sorted dataset")
        df = df.orderBy(*shaping.keys(by)).limit(limits["outobs"])
    return df, order


#: Most values that INTO reads into macro variables.
INTO_VALUES = 10_000


def into(program: Program, df: DataFrame, targets: str) -> None:
    """INTO :a, :b SEPARATED BY 'x', :c1 - :c9. More than INTO_VALUES rows for a list are refused; without a list the first rows are read."""
    names = re.findall(r":\s*(\w+)(?:\s*-\s*:?\s*(\w+))?(?:\s+separated\s+by\s+(?:'([^']*)'|\"([^\"]*)\"))?(?:\s+notrim)?\s*(?:,|$)", targets, re.I)
    if len(names) != len(arguments(f"({targets})", 0)[0]) or len(names) > len(df.columns):
        raise UnsupportedConstruct(f"INTO {targets}")
    many = bool(re.search(r"\bseparated\s+by\b", targets, re.I))
    count = 0 if many else max((int(re.sub(r"\D", "", b)) for _, b, _, _ in names if b), default=1)
    rows = df.limit(INTO_VALUES + 1 if many else count).collect()
    if len(rows) > INTO_VALUES:
        raise UnsupportedConstruct(f"INTO {targets}: more than {INTO_VALUES} values")
    for i, ((name, last, one, two), part) in enumerate(zip(names, arguments(f"({targets})", 0)[0], strict=True)):
        values = ["" if r[i] is None else str(r[i]) for r in rows]
        if re.search(r"\bseparated\s+by\b", part, re.I):
            program.macros.variables[name.lower()] = (one or two).join(v for r, v in zip(rows, values, strict=True) if r[i] is not None)
        elif last:
            base, first = re.fullmatch(r"(\w*?)(\d+)", name).groups()
            for k, v in enumerate(values[: int(re.sub(r"\D", "", last)) - int(first) + 1]):
                program.macros.variables[f"{base.lower()}{int(first) + k}"] = v
        elif values:
            program.macros.variables[name.lower()] = values[0]


def insert(program: Program, name: str, columns: str | None, rest: str) -> None:
    """INSERT INTO with VALUES or SET, once or several times; columns that are not named are missing."""
    base = program.frame(name)
    named = [c.strip().lower() for c in columns.strip("()").split(",")] if columns else [c.lower() for c in base.columns]
    rows: list[dict[str, str]] = []
    while rest := rest.strip().lstrip(","):
        if m := re.match(r"values\s*(?=\()", rest, re.I):
            values, end = arguments(rest, m.end())
            if len(values) != len(named):
                raise UnsupportedConstruct(f"INSERT INTO {name}: {len(values)} values for {len(named)} columns")
            rows.append(dict(zip(named, values, strict=True)))
        elif m := re.match(r"set\s+((?:(?!\bset\s+\w+\s*=)(?:'[^']*'|\"[^\"]*\"|.))*)", rest, re.I | re.S):
            rows.append({k.strip().lower(): v.strip() for k, _, v in (x.partition("=") for x in arguments(f"({m[1]})", 0)[0])})
            end = m.end()
        else:
            raise UnsupportedConstruct(f"INSERT INTO {name} {rest}")
        rest = rest[end:]
    unknown = {k for r in rows for k in r} - {c.lower() for c in base.columns}
    if unknown:
        raise UnsupportedConstruct(f"INSERT INTO {name}: no column {', '.join(sorted(unknown))}")
    value = lambda r, c: F.lit(None) if r.get(c.lower(), ".") == "." else F.expr(rewrite(r[c.lower()], program))
    new = [F.struct(*[value(r, c).cast(t).alias(c) for c, t in base.dtypes]) for r in rows]
    program.bind(name, concatenate(base, program.spark.range(1).select(F.inline(F.array(*new)))))


def run_sql(program: Program, statement: str, limits: dict[str, int] | None = None) -> None:
    s, limits = statement.strip(), limits or {}
    if m := re.fullmatch(r"create\s+(?:table|view)\s+([\w.]+)\s*(?:\([^)]*\)\s*)?as\s+(.*)", s, re.I | re.S):
        df, order = ordered(program, m[2], limits)
        program.bind(m[1], df, order)
    elif m := re.fullmatch(r"create\s+table\s+([\w.]+)\s+like\s+([\w.]+)", s, re.I):
        program.bind(m[1], program.frame(m[2]).limit(0))
    elif m := re.fullmatch(r"create\s+table\s+([\w.]+)\s*(\(.*\))", s, re.I | re.S):
        kinds = {"num": "double", "numeric": "double", "float": "double", "double": "double", "integer": "double", "int": "double", "smallint": "double", "char": "string", "character": "string", "varchar": "string", "date": "date", "datetime": "timestamp"}
        columns = []
        for part in arguments(m[2], 0)[0]:
            d = re.match(r"(\w+)\s+(\w+)\s*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?\s*((?:(?:format|informat|label)\s*=\s*\S+\s*)*)$", part, re.I)
            if not d or d[2].lower() not in kinds:
                raise UnsupportedConstruct(f"{part} in CREATE TABLE")
            columns.append(f"{d[1].lower()} {kinds[d[2].lower()]}")
        program.bind(m[1], program.spark.createDataFrame([], ", ".join(columns)))
    elif m := re.fullmatch(r"select\s+(.*?)\s+into\s+(:.*?)\s+(from\b.*)", s, re.I | re.S):
        into(program, select(program, f"select {m[1]} {m[3]}"), m[2])
    elif m := re.fullmatch(r"insert\s+into\s+([\w.]+)\s*(\([^()]*\))?\s*((?:values|set)\b.*)", s, re.I | re.S):
        insert(program, m[1], m[2], m[3])
    elif m := re.fullmatch(r"insert\s+into\s+([\w.]+)\s+(select\b.*)", s, re.I | re.S):
        new = select(program, m[2])
        program.bind(m[1], concatenate(program.frame(m[1]), new.toDF(*program.frame(m[1]).columns)))
    elif m := re.fullmatch(r"delete\s+from\s+([\w.]+)(?:\s+where\s+(.*))?", s, re.I | re.S):
        d = program.dataset(m[1])
        program.bind(m[1], d.frame.where(f"NOT coalesce({rewrite(m[2], program)}, false)") if m[2] else d.frame.limit(0), d.order)
    elif m := re.fullmatch(r"update\s+([\w.]+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", s, re.I | re.S):
        d = program.dataset(m[1])
        changes = {}
        for part in arguments(f"({m[2]})", 0)[0]:
            name, _, value = part.partition("=")
            new = F.expr(rewrite(value, program))
            changes[name.strip()] = F.when(F.expr(rewrite(m[3], program)), new).otherwise(F.col(name.strip())) if m[3] else new
        program.bind(m[1], d.frame.withColumns(changes), d.order)
    elif m := re.fullmatch(r"drop\s+(?:table|view)\s+(.*)", s, re.I | re.S):
        for name in m[1].split(","):
            program.forget(name.strip())
    elif re.match(r"select\b", s, re.I):
        program.bind("_select_", *ordered(program, s, limits))
    else:
        raise UnsupportedConstruct(s)
