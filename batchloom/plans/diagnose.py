"""What went wrong in a run, by category, and a report of runs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from batchloom.lang.statements import UnsupportedConstruct


@dataclass(frozen=True)
class Diagnosis:
    category: str
    advice: str
    subject: str = ""


#: Category and advice by the beginning of Spark's error condition; the first that fits counts.
CONDITIONS = (
    ("TABLE_OR_VIEW_NOT_FOUND", "missing_table", "bind the dataset or check its library; preflight() lists sources that nothing provides"),
    ("PATH_NOT_FOUND", "missing_table", "the library's folder has no such dataset"),
    ("UNRESOLVED_COLUMN", "unresolved_column", "no variable of that name; check KEEP=, DROP= and RENAME= before this step"),
    ("AMBIGUOUS", "ambiguous_column", "qualify the column or rename it on one side"),
    ("UNRESOLVED_ROUTINE", "unknown_function", "the function is not in batchloom.functions"),
    ("WRONG_NUM_ARGS", "wrong_arguments", "the call has too many or too few arguments"),
    ("DATATYPE_MISMATCH", "type_mismatch", "convert with PUT or INPUT first"),
    ("CAST_INVALID_INPUT", "bad_value", "text that is no number or date; INPUT gives missing for it"),
    ("CANNOT_PARSE", "bad_value", "text that does not fit the informat"),
    ("DIVIDE_BY_ZERO", "division_by_zero", "use missing.divide, which gives missing"),
    ("ARITHMETIC_OVERFLOW", "overflow", "convert to double first"),
    ("PARSE_SYNTAX_ERROR", "syntax", "the statement could not be read as SQL"),
    ("MISSING_GROUP_BY", "grouping", "a column is neither grouped nor aggregated"),
    ("MISSING_AGGREGATION", "grouping", "a column is neither grouped nor aggregated"),
    ("NUM_COLUMNS_MISMATCH", "column_count", "both sides of a set operation need the same columns; OUTER UNION CORR matches by name"),
    ("SCHEMA", "schema_change", "the stored dataset has other columns; write a new version"),
    ("DUPLICATED_MAP_KEY", "duplicate_key", "keys repeat; see assert_unique"),
    ("USER_RAISED_EXCEPTION", "check_failed", "a check in the data failed; the message says which"),
)


def diagnose(error: BaseException) -> Diagnosis:
    """Category, advice and subject (a column, table or statement) of an error that a run raised."""
    if isinstance(error, UnsupportedConstruct):
        return Diagnosis("unsupported", "rewrite the statement with the operators named in README", str(error))
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    names = re.findall(r"`([^`]+)`", str(error))
    for start, category, advice in CONDITIONS:
        if (condition or "").startswith(start) or f"[{start}" in str(error):
            return Diagnosis(category, advice, names[0] if names else "")
    if isinstance(error, ValueError):
        return Diagnosis("program", "the program text cannot be compiled", str(error))
    if re.search(r"OutOfMemory|Container killed|exit code 137", str(error)):
        return Diagnosis("memory", "more shuffle partitions or memory; look for one large group")
    return Diagnosis("unknown", "see the driver's log")


def run_report(spark: SparkSession, runs: Iterable[tuple[str, str, float, BaseException | None]]) -> DataFrame:
    """(job, status, seconds, category, advice) of runs given as (job, status, seconds, error), and a line ``*`` with the share that is done and all seconds."""
    rows = []
    for job, status, seconds, error in runs:
        d = diagnose(error) if error else None
        rows.append((job, status, float(seconds), d.category if d else None, d.advice if d else None))
    done = sum(r[1] == "DONE" for r in rows)
    rows.append(("*", f"{done} of {len(rows)} done", float(sum(r[2] for r in rows)), None, None))
    return spark.createDataFrame(rows, "job string, status string, seconds double, category string, advice string")
