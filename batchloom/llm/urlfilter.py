"""URL filter: explicit rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (``labelled_urls.tsv`` by default; the bound is MAX_LABELLED rows) by full-batch
gradient descent; it is a vector of DIMENSIONS weights, sent to the executors with the task. Rules are DataFrame expressions.

Defined results. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. Null or no ``://``: both empty; the model then sees no n-gram and its bias decides. The longest rule (host and path together) wins,
among equally long ones the longer host. An empty path fits no rule. An empty table gives no rows; repeated rows get the same result.
Columns named url_host, url_path, url_rule, url_score or url_verdict are replaced.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.textblocks import _BASE, mix, replaced

DIMENSIONS = 1 << 15
SIZES = (3, 4, 5)
MAX_LABELLED = 100_000
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The labelled table: lines of label (1 unwanted, 0 wanted) and URL, written by hand for this filter.
LABELLED_FILE = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = LABELLED_FILE) -> list[tuple[str, int]]:
    """(url, label) of a file."""
    lines = Path(path).read_text().splitlines()
    return [(url, int(label)) for label, url in (line.split("\t") for line in lines if line and not line.startswith("#"))]


def host(url: str) -> Column:
    whole = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_col: str, path_col: str, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (len(x[1]), x[1].index("/"))):  # the last that fits stands
        at, below = r[: r.index("/")], r[r.index("/") :]
        fits = ((F.col(host_col) == at) | F.col(host_col).endswith(f".{at}")) & F.col(path_col).startswith(below)
        text, verdict = F.when(fits, r).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each distinct n-gram; host and path n-grams have slots of their own."""
    rows, slots = [], []
    for field, values in enumerate((hosts, paths)):
        raw = [v.encode() for v in values]
        size = np.array([len(v) + 2 for v in raw], dtype=np.int64)
        buf = np.frombuffer(b"".join(b"^" + v + b"$" for v in raw), dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), size)
        for n in SIZES:
            h = np.zeros(max(0, len(buf) - n + 1), dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(_BASE) + buf[i : i + len(h)] + np.uint64(1)
            inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
            rows.append(owner[: len(h)][inside])
            slots.append((mix(h[inside] + np.uint64(1000 * field + n)) % np.uint64(DIMENSIONS)).astype(np.int64))
    both = np.unique(np.concatenate(rows) * DIMENSIONS + np.concatenate(slots))
    return both // DIMENSIONS, both % DIMENSIONS


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL on the driver, as the column expressions have them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    stop = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def train(labelled, rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights, with the bias last. Deterministic."""
    labelled = list(labelled)
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"a labelled table has at most {MAX_LABELLED} rows")
    parts = [split_url(u) for u, _ in labelled]
    y = np.array([t for _, t in labelled], dtype=np.float64)
    row, slot = features([h for h, _ in parts], [p for _, p in parts])
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w = np.zeros(DIMENSIONS + 1)
    for _ in range(rounds if len(y) else 0):
        z = np.bincount(row, weights=w[slot], minlength=len(y)) * value + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w[:-1] -= rate * (np.bincount(slot, weights=(g * value)[row], minlength=DIMENSIONS) + decay * w[:-1])
        w[-1] -= rate * g.sum()
    return w


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """All rows and columns with url_host, url_path, url_rule, url_score (chance of unwanted) and url_verdict."""
    w = train(labelled_urls() if labelled is None else labelled)
    pages = replaced(pages, "url_host", "url_path", "url_rule", "url_score", "url_verdict")
    own = pages.columns
    plain = pages.toDF(*[f"c{i}" for i in range(len(own))])
    url = plain.columns[own.index(url_col)]
    plain = plain.withColumns({"url_host": host(url), "url_path": path(url)})

    @F.pandas_udf("double")
    def score(hosts, paths):
        import pandas as pd

        row, slot = features(hosts.tolist(), paths.tolist())
        count = np.bincount(row, minlength=len(hosts))
        z = np.bincount(row, weights=w[slot], minlength=len(hosts)) / np.sqrt(np.maximum(count, 1)) + w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    text, verdict = rule("url_host", "url_path", rules)
    out = plain.withColumns({"url_rule": text, "said": verdict, "url_score": score("url_host", "url_path")})
    out = out.withColumn("url_verdict", F.coalesce("said", F.when(F.col("url_score") >= threshold, "block").otherwise("allow"))).drop("said")
    return out.toDF(*own, "url_host", "url_path", "url_rule", "url_score", "url_verdict")
