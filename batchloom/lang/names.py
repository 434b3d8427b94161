"""Lists of variables: numbered ranges, prefixes, ranges by position, and lists by type."""

from __future__ import annotations

import re
from collections.abc import Sequence

from batchloom.lang.statements import UnsupportedConstruct

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def expanded(text: str, columns: Sequence[tuple[str, str]]) -> list[str]:
    """Names of a list, lower case and each once: ``a x1-x3 y: b--d _numeric_ _character_ _all_`` against (name, type) pairs. Numbered ranges need no such columns: an array may make them."""
    known = [(c.lower(), t) for c, t in columns]
    names = [c for c, _ in known]
    out: list[str] = []
    for w in re.sub(r"\s*(--?)\s*", r"\1", text.lower()).split():
        if m := re.fullmatch(r"([a-z_]\w*?)(\d+)-([a-z_]\w*?)(\d+)", w):
            if m[1] != m[3] or int(m[2]) > int(m[4]):
                raise UnsupportedConstruct(f"variable list {w}")
            width = len(m[2]) if m[2].startswith("0") else 1
            out += [f"{m[1]}{i:0{width}d}" for i in range(int(m[2]), int(m[4]) + 1)]
        elif m := re.fullmatch(r"(\w+)--(\w+)", w):
            if m[1] not in names or m[2] not in names:
                raise UnsupportedConstruct(f"variable list {w}")
            out += names[names.index(m[1]) : names.index(m[2]) + 1]
        elif w.endswith(":"):
            out += [c for c in names if c.startswith(w[:-1])]
        elif w in ("_numeric_", "_character_", "_char_", "_all_"):
            out += [c for c, t in known if w == "_all_" or (_number(t) if w == "_numeric_" else t == "string")]
        elif re.fullmatch(r"\w+", w):
            out.append(w)
        else:
            raise UnsupportedConstruct(f"variable list {w}")
    return list(dict.fromkeys(out))
