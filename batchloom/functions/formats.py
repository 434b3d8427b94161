"""Output formats (``put``) and informats (``input_``): a name with optional width and decimals, such as ``COMMA12.2`` or ``DATE9.``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.missing import col

#: Date and datetime formats as patterns; upper marks those written in capitals.
DATE_PATTERNS = {
    "DATE7": ("ddMMMyy", True), "DATE9": ("ddMMMyyyy", True), "DATE11": ("dd-MMM-yyyy", True), "DATETIME18": ("ddMMMyy:HH:mm:ss", True), "DATETIME19": ("ddMMMyyyy:HH:mm:ss", True),
    "DATETIME20": ("ddMMMyyyy:HH:mm:ss", True), "MMDDYY8": ("MM/dd/yy", False), "MMDDYY10": ("MM/dd/yyyy", False), "DDMMYY8": ("dd/MM/yy", False), "DDMMYY10": ("dd/MM/yyyy", False),
    "YYMMDD8": ("yy-MM-dd", False), "YYMMDD10": ("yyyy-MM-dd", False), "YYMMDDN8": ("yyyyMMdd", False), "YYMMDDN": ("yyyyMMdd", False), "YYMMN6": ("yyyyMM", False), "MONYY5": ("MMMyy", True),
    "MONYY7": ("MMMyyyy", True), "E8601DA": ("yyyy-MM-dd", False), "E8601DT": ("yyyy-MM-dd'T'HH:mm:ss", False), "IS8601DA": ("yyyy-MM-dd", False), "IS8601DT": ("yyyy-MM-dd'T'HH:mm:ss", False),
    "B8601DA": ("yyyyMMdd", False), "B8601DT": ("yyyyMMdd'T'HHmmss", False), "WEEKDATE": ("EEEE, MMMM dd, yyyy", False), "WORDDATX": ("dd MMMM yyyy", False), "NLDATE": ("dd MMMM yyyy", False),
    "NLDATM": ("dd MMMM yyyy HH:mm:ss", False), "EURDFDE": ("dd.MM.yyyy", False), "MONNAME": ("MMMM", False), "YEAR4": ("yyyy", False), "YEAR": ("yyyy", False), "MONTH": ("M", False),
    "JULDAY": ("D", False), "JULIAN7": ("yyyyDDD", False), "JULIAN5": ("yyDDD", False),
}
#: The pattern of a name written without a width.
DATE_DEFAULTS = {"DATE": "DATE9", "DATETIME": "DATETIME20", "MMDDYY": "MMDDYY10", "DDMMYY": "DDMMYY10", "YYMMDD": "YYMMDD10", "MONYY": "MONYY5", "YYMMN": "YYMMN6", "JULIAN": "JULIAN5"}
#: Informats as the patterns tried in order.
DATE_INFORMATS = {
    "DATE": ("ddMMMyyyy", "ddMMMyy"), "MMDDYY": ("MM/dd/yyyy", "MM-dd-yyyy", "MMddyyyy"), "DDMMYY": ("dd/MM/yyyy", "dd-MM-yyyy", "ddMMyyyy"), "YYMMDD": ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"),
    "YYMMN": ("yyyyMM",), "MONYY": ("MMMyyyy", "MMMyy"), "JULIAN": ("yyyyDDD",), "E8601DA": ("yyyy-MM-dd",), "IS8601DA": ("yyyy-MM-dd",), "B8601DA": ("yyyyMMdd",), "NLDATE": ("dd MMMM yyyy",),
    "ANYDTDTE": ("yyyy-MM-dd", "ddMMMyyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd"),
}
TIMESTAMP_INFORMATS = {
    "DATETIME": ("ddMMMyyyy:HH:mm:ss", "dd-MMM-yyyy HH:mm:ss"), "E8601DT": ("yyyy-MM-dd'T'HH:mm:ss",), "IS8601DT": ("yyyy-MM-dd'T'HH:mm:ss",), "B8601DT": ("yyyyMMdd'T'HHmmss",), "NLDATM": ("dd MMMM yyyy HH:mm:ss",),
    "ANYDTDTM": ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "ddMMMyyyy:HH:mm:ss", "dd-MMM-yyyy HH:mm:ss"),
}


def parse(name: str) -> tuple[str, int | None, int]:
    """Name without width, width and decimals of a format: ``DOLLAR12.2`` is DOLLAR, 12, 2."""
    m = re.fullmatch(r"(\$?[A-Za-z_]*(?:8601[A-Za-z]{2})?)(\d*)(?:\.(\d*))?", name.strip())
    if not m:
        raise ValueError(f"not a format: {name}")
    return m[1].upper(), int(m[2]) if m[2] else None, int(m[3]) if m[3] else 0


def _european(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def _plain_number(x: Column) -> Column:
    """A number without exponent or trailing zeros, to fifteen digits."""
    text = F.format_string("%.10f", x)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _exponent(x: Column, q: int) -> Column:
    """Exponent notation with at most ``q`` decimals, without trailing zeros. Ties go to the even digit, as in C's printf; Java's formatter rounds them up."""
    whole, kept = F.format_string("%.16E", x), r"^(-?[02468])\.50*E" if q == 0 else rf"^(-?\d\.\d{{{q - 1}}}[02468])50*E"
    text = F.when(whole.rlike(kept), F.regexp_replace(whole, kept, "$1E")).otherwise(F.format_string(f"%.{q}E", x))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0*E", "$1E"), r"\.?E(?:\+|(-))0*", "E$1")


def _fixed(x: Column, width: int | None, d: int) -> Column:
    """w.d: right-aligned. What does not fit loses decimals, then goes to an exponent, as BESTw. does; else asterisks."""
    if width is None:
        return F.format_string(f"%1.{d}f", x)
    tries = [F.format_string(f"%.{q}f", x) for q in range(d, -1, -1)]
    tries += [_exponent(x, q) for q in range(max(0, width - 4), -1, -1)]
    fitting = F.coalesce(*[F.when(F.length(text) <= width, text) for text in tries], F.lit("*" * width))
    return F.lpad(fitting, width, " ")


def _best(x: Column, width: int) -> Column:
    """BESTw.: as many significant digits as fit the width, without trailing zeros; an exponent where a plain number would lose more. Not padded.

    The number's size tells how many decimals fit, so a row is formatted once; each branch stands once in the expression, as branches that hold each other grow with every width tried.
    """

    def trimmed(q: int) -> Column:
        text = F.format_string(f"%.{q}f", x)
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if q else text

    def below(digits: int) -> Column:
        """At most so many digits, a minus counted, stand before the point."""
        return (x < 10.0**digits) & (x > -(10.0 ** (digits - 1)) if digits > 1 else x >= 0)

    tries = [_exponent(x, q) for q in range(max(0, min(width - 5, 14)), -1, -1)]
    scientific = F.coalesce(*[F.when(F.length(text) <= width, text) for text in tries], F.lit("*" * width))
    plain = F.when(x == 0, "0")
    for q in range(min(width - 2, 15), 0, -1):  # the most decimals that fit
        plain = plain.when(below(width - 1 - q), trimmed(q))
    plain = plain.otherwise(trimmed(0))
    fits = (x < 10.0**width - 0.5) & (x > (-(10.0 ** (width - 1)) + 0.5 if width > 1 else -0.5))
    # numbers that would show as zero, and small ones that lose leading digits to zeros
    zero = (x != 0) & (x < 0.5 * 10.0 ** -max(width - 2, 0)) & (x > -0.5 * 10.0 ** -max(width - 3, 0))
    small = (x != 0) & (F.abs(x) < 1e-4) & (F.length(trimmed(15)) > width - F.when(x < 0, 1).otherwise(0))
    return F.when(fits & ~zero & ~small, plain).otherwise(scientific)


def _fraction(x: Column) -> Column:
    """FRACTw.: the fraction of least denominator up to 1000 that equals the number to 1e-6; else the plain number.

    The fraction of least denominator between two numbers is found by their continued fractions: while they share a whole part, it is taken off and the rests are turned over. 17 turns pass the denominator 1000.
    """
    whole, rest = F.floor(F.abs(x)), F.abs(x) - F.floor(F.abs(x))
    names = ("lo", "hi", "p0", "q0", "p", "q", "done")

    def state(*values) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(names, values, strict=True)])

    def step(s: Column, _: Column) -> Column:
        a = F.floor(s["lo"])
        last = a + 1 < s["hi"]
        part = F.when(last, a + 1).otherwise(a)
        turned = F.when(last | (s["lo"] == a), float("inf")).otherwise(F.try_divide(F.lit(1.0), s["lo"] - a))
        made = state(F.when(last, 0.0).otherwise(F.try_divide(F.lit(1.0), s["hi"] - a)), turned, s["p"], s["q"], part * s["p"] + s["p0"], part * s["q"] + s["q0"], last)
        return F.when(s["done"] | (s["q"] > 1000), s).otherwise(made)

    def text(s: Column) -> Column:
        ratio = F.concat(s["p"].cast("string"), F.lit("/"), s["q"].cast("string"))
        found = F.when(s["q"] == 1, (whole + s["p"]).cast("string")).when(whole == 0, ratio).otherwise(F.concat(whole.cast("string"), F.lit("+"), ratio))
        return F.when(s["done"] & (s["q"] <= 1000), found)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    found = F.when(rest < 1e-6, whole.cast("string")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(17)), state(rest - 1e-6, rest + 1e-6, zero, one, one, zero, False), step, text))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(found, _plain_number(F.abs(x))))


def put(x, fmt: str) -> Column:
    """A value as text; missing values give missing (numbers: a dot is left to the caller)."""
    x = col(x)
    base, width, d = parse(fmt)
    key = f"{base}{width}" if width is not None and f"{base}{width}" in DATE_PATTERNS else base if base in DATE_PATTERNS else DATE_DEFAULTS.get(base)
    if key:
        pattern, upper = DATE_PATTERNS[key]
        text = F.date_format(x, pattern)
        return F.upper(text) if upper else text
    number = x.cast("double") if not base.startswith("$") else x
    if base in ("TIME", "HHMM", "TOD"):
        # a number is seconds; of a timestamp the clock time counts
        as_text = x.cast("string")
        clock = F.hour(as_text.try_cast("timestamp")) * 3600 + F.minute(as_text.try_cast("timestamp")) * 60 + F.second(as_text.try_cast("timestamp"))
        seconds = F.coalesce(as_text.try_cast("double"), clock.cast("double"))
        h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
        return F.format_string("%02d:%02d:%02d", h, m, s) if base != "HHMM" else F.format_string("%02d:%02d", h, m)
    made = {
        "DOLLAR": lambda: F.concat(F.when(number < 0, "-").otherwise(""), F.lit("$"), F.format_string(f"%,.{d}f", F.abs(number))),
        "COMMA": lambda: F.format_string(f"%,.{d}f", number),
        "COMMAX": lambda: _european(F.format_string(f"%,.{d}f", number)),
        "DOLLARX": lambda: F.concat(F.lit("$"), _european(F.format_string(f"%,.{d}f", number))),
        "EUROX": lambda: F.concat(F.lit("€"), _european(F.format_string(f"%,.{d}f", number))),
        "NLNUM": lambda: F.format_string(f"%,.{d}f", number),
        "NLMNY": lambda: F.format_string(f"$%,.{d}f", number),
        "PERCENT": lambda: F.when(number < 0, F.format_string(f"(%.{d}f%%)", -number * 100)).otherwise(F.format_string(f"%.{d}f%%", number * 100)),
        "BEST": lambda: _best(number, width or 12),
        "FRACT": lambda: _fraction(number),
        "Z": lambda: F.format_string(f"%0{width or 1}.{d}f" if d else f"%0{width or 1}d", number if d else number.cast("long")),
        "F": lambda: _fixed(number, width, d),
        "": lambda: _fixed(number, width, d),
        "E": lambda: F.upper(F.format_string(f"%.{max(1, (width or 12) - 7)}e", number)),
        "PVALUE": lambda: F.when(number < 10.0**-(d or 4), f"<{'.' + '0' * ((d or 4) - 1) + '1'}").otherwise(F.format_string(f"%.{d or 4}f", number)),
        "BINARY": lambda: F.lpad(F.bin(number.cast("long")), width or 8, "0"),
        "HEX": lambda: F.lpad(F.hex(number.cast("long")), width or 8, "0"),
        "QTR": lambda: F.quarter(x).cast("string"),
        "WEEKDAY": lambda: F.dayofweek(x).cast("string"),
        "$CHAR": lambda: F.substring(x, 1, width) if width else x,
        "$": lambda: F.substring(x, 1, width) if width else x,
        "$VARYING": lambda: F.substring(x, 1, width) if width else x,
        "$UPCASE": lambda: F.upper(F.substring(x, 1, width) if width else x),
        "$QUOTE": lambda: F.concat(F.lit('"'), x, F.lit('"')),
    }
    if base not in made:
        raise ValueError(f"unknown format {fmt}")
    return F.when(x.isNotNull(), made[base]())


def _ebcdic(x: Column) -> Column:
    """Text whose characters stand for the bytes of code page 037, as the characters those bytes mean."""
    chars = [(chr(b), bytes([b]).decode("cp037")) for b in range(1, 256)]
    return F.translate(x, "".join(a for a, _ in chars), "".join(b for _, b in chars))


def input_(x, informat: str) -> Column:
    """Text as a value; text that doesn't fit gives missing."""
    x = F.trim(col(x).cast("string"))
    base, width, d = parse(informat)
    for table, read in ((DATE_INFORMATS, F.try_to_date), (TIMESTAMP_INFORMATS, lambda c, p: F.try_to_timestamp(c, F.lit(p)))):
        if base in table:
            return F.coalesce(*[read(x, p) for p in table[base]])
    digits = {"COMMA": "[,$%\\s()]", "DOLLAR": "[,$\\s()]", "NLNUM": "[,\\s]", "NLMNY": "[,$\\s]"}
    if base in digits:
        value = F.regexp_replace(x, digits[base], "").try_cast("double")
        return F.when(x.startswith("("), -value).otherwise(value)
    if base in ("COMMAX", "DOLLARX", "EUROX"):
        return F.translate(F.regexp_replace(x, r"[.$€\s]", ""), ",", ".").try_cast("double")
    if base == "PERCENT":
        value = F.regexp_replace(x, r"[%,\s()]", "").try_cast("double")
        return F.when(x.startswith("("), -value).otherwise(value) / F.when(x.contains("%"), 100.0).otherwise(1.0)
    if base in ("BEST", "F", "", "E"):
        value = x.try_cast("double")
        return value if not d else F.when(x.contains("."), value).otherwise(value / 10**d)
    if base == "HEX":
        return F.conv(x, 16, 10).try_cast("double")
    if base == "TIME" or base == "E8601TM":
        p = F.split(x, ":")
        at = lambda i: F.get(p, F.lit(i)).try_cast("double")
        return at(0) * 3600 + at(1) * 60 + F.coalesce(at(2), F.lit(0.0))
    if base == "$EBCDIC":
        raw = _ebcdic(col(x))
        return F.substring(raw, 1, width) if width else raw
    if base in ("$CHAR", "$", "$VARYING", "$ASCII"):
        return F.substring(col(x), 1, width) if width else x
    raise ValueError(f"unknown informat {informat}")
