"""Scalar functions by their dialect name."""

from __future__ import annotations

from batchloom.functions import dates, formats, numbers, text

#: Python names that differ from the dialect's.
_RENAMED = {"ABS": numbers.abs_, "ROUND": numbers.round_, "INT": numbers.int_, "MAX": numbers.max_, "MIN": numbers.min_, "SUM": numbers.sum_, "RANGE": numbers.range_, "PUT": formats.put, "INPUT": formats.input_}
_PLAIN = {
    text: "SUBSTR SCAN CATX CATS CATT CAT CATQ COMPRESS STRIP TRIM LEFT RIGHT UPCASE LOWCASE PROPCASE TRANWRD INDEX FIND LENGTH LENGTHN REPEAT REVERSE TRANSLATE ANYALPHA ANYDIGIT",
    numbers: "CEIL FLOOR MOD SIGN SQRT LOG LOG10 EXP N NMISS CMISS MEAN USS CSS STD COALESCE COALESCEC IFN IFC MISSING",
    dates: "INTCK INTNX DATEPART TIMEPART TODAY DATETIME MDY YMD YEAR QTR MONTH DAY WEEKDAY HOUR MINUTE SECOND DHMS HMS DATDIF",
}
FUNCTIONS = _RENAMED | {name: getattr(module, name.lower()) for module, names in _PLAIN.items() for name in names.split()} | {"DATE": dates.today, "TIME": dates.time}


def call(name: str, *args):
    """The function's result as a column; unknown names raise."""
    if name.upper() not in FUNCTIONS:
        raise ValueError(f"unknown function {name}")
    return FUNCTIONS[name.upper()](*args)
