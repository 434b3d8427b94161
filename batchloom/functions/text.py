"""Text functions of the batch dialect as column expressions. Positions start at 1; arguments are columns or plain values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.missing import blank_to_null, col

#: The delimiters that SCAN uses by default.
SCAN_DELIMITERS = " !$%&()*+,-./;<^|"


def _class(chars: str) -> str:
    return "[" + "".join(re.sub(r"([\\\[\]^&\-~|])", r"\\\1", c) for c in chars) + "]"


def substr(s, pos, n=None) -> Column:
    s = col(s)
    return F.substr(s, col(pos)) if n is None else F.substr(s, col(pos), col(n))


def scan(s, n, delimiters: str = SCAN_DELIMITERS) -> Column:
    """The n-th word (from the right if n is negative); runs of delimiters count once; missing beyond the last word."""
    words = F.filter(F.split(col(s), _class(delimiters) + "+"), lambda w: w != "")
    n = col(n).cast("int")
    return F.when(n != 0, F.try_element_at(words, n))


def catx(separator, *parts) -> Column:
    return F.concat_ws(separator, *[blank_to_null(F.trim(col(p).cast("string"))) for p in parts])


def cats(*parts) -> Column:
    return F.concat(*[F.coalesce(F.trim(col(p).cast("string")), F.lit("")) for p in parts])


def catt(*parts) -> Column:
    return F.concat(*[F.coalesce(F.rtrim(col(p).cast("string")), F.lit("")) for p in parts])


def cat(*parts) -> Column:
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def catq(separator, *parts) -> Column:
    """Parts joined by a separator, each in quotes, without missing ones."""
    quoted = [F.when(blank_to_null(col(p).cast("string")).isNotNull(), F.concat(F.lit('"'), F.replace(F.trim(col(p).cast("string")), F.lit('"'), F.lit('""')), F.lit('"'))) for p in parts]
    return F.concat_ws(separator, *quoted)


#: What each modifier of COMPRESS adds to the set of characters, as a regular expression class body.
COMPRESS_SETS = {"a": "A-Za-z", "d": "0-9", "s": r"\s", "p": r"\p{Punct}", "u": "A-Z", "l": "a-z", "n": "A-Za-z0-9_"}


def compress(s, chars: str | None = None, modifiers: str = "") -> Column:
    """Removes (with modifier k: keeps only) the given characters; without any, blanks."""
    modifiers = modifiers.lower()
    body = _class(chars)[1:-1] if chars else ""
    body += "".join(COMPRESS_SETS[m] for m in modifiers if m in COMPRESS_SETS)
    if not body:
        body = " "
    flags = "(?i)" if "i" in modifiers else ""
    return F.regexp_replace(col(s), f"{flags}[{'^' if 'k' in modifiers else ''}{body}]", "")


def strip(s) -> Column:
    return F.trim(col(s))


def trim(s) -> Column:
    return F.rtrim(col(s))


def left(s) -> Column:
    return F.ltrim(col(s))


def right(s) -> Column:
    """Trailing blanks moved to the front."""
    s = col(s)
    return F.lpad(F.rtrim(s), F.length(s), F.lit(" "))


def upcase(s) -> Column:
    return F.upper(col(s))


def lowcase(s) -> Column:
    return F.lower(col(s))


def propcase(s, delimiters: str = " ") -> Column:
    s = F.lower(col(s))
    if delimiters == " ":
        return F.initcap(s)
    letters = F.split(s, "")
    at = F.sequence(F.lit(0), F.size(letters) - 1)
    starts = lambda i: (i == 0) | F.get(letters, i - 1).isin(*delimiters)
    return F.array_join(F.transform(at, lambda i: F.when(starts(i), F.upper(F.get(letters, i))).otherwise(F.get(letters, i))), "")


def tranwrd(s, old, new) -> Column:
    return F.replace(col(s), col(old), col(new))


def index(s, sub) -> Column:
    return F.locate(sub, col(s)) if isinstance(sub, str) else F.position(sub, col(s))


def find(s, sub: str, modifiers: str = "", start: int = 1) -> Column:
    """Position of a text, 0 if absent; modifier i ignores case; a negative start searches leftwards from there."""
    s = col(s)
    if "i" in modifiers.lower():
        s, sub = F.lower(s), sub.lower()
    if start >= 0:
        return F.locate(sub, s, max(start, 1))
    head = F.substr(s, F.lit(1), F.lit(-start + len(sub) - 1))
    at = F.locate(sub[::-1], F.reverse(head))
    return F.when(at > 0, F.length(head) - len(sub) - at + 2).otherwise(F.when(s.isNotNull(), 0))


def length(s) -> Column:
    return F.greatest(F.length(F.rtrim(F.coalesce(col(s), F.lit("")))), F.lit(1))


def lengthn(s) -> Column:
    return F.length(F.rtrim(F.coalesce(col(s), F.lit(""))))


def repeat(s, n) -> Column:
    return F.repeat(col(s), col(n) + 1)


def reverse(s) -> Column:
    return F.reverse(col(s))


def translate(s, to: str, old: str) -> Column:
    """Characters of ``old`` become those of ``to`` at the same place; where ``to`` is shorter, a blank."""
    return F.translate(col(s), old, to.ljust(len(old))[: len(old)])


def anyalpha(s) -> Column:
    return F.regexp_instr(col(s), F.lit("[A-Za-z]"))


def anydigit(s) -> Column:
    return F.regexp_instr(col(s), F.lit("[0-9]"))
