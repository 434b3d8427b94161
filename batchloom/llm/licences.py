"""License scans with a positional rare-token index, with DataFrame functions only.

Method. Templates (``licence_templates.tsv``: label, mandatory key phrases, text) are cut into words. A word's rarity is its inverse document frequency over all scanned documents; the index holds, for the ANCHORS
rarest words of each template, postings (template, position), so what a file looks up is its licence words of highest IDF. A posting at position q hit by the file's word i says that the template would start at i - q;
hits that agree on (file, template, start) are intersected. An alignment counts where the agreeing words hold at least SHARE of the template's weight (summed IDF) and each key phrase of the template stands,
word by word, at its place of the alignment. Base phrases are found by position alone, whatever the index says.

Scale. Two narrow passes over the texts: one counts the templates' vocabulary (partial counts first), one makes slim rows, which are written. Only hits are shuffled: a few numbers for each, or-ed into bit masks before
they are shuffled, so a license line that a third of all documents repeats costs a row a document. Copies of a text share their hits through its digest. The index is as large as the template table, which is fixed.

Defined results. Null text counts as empty. Repeated rows are scanned alike. Texts of any length are scanned whole; a text without licence words has no labels and score 0. An empty table gives no rows; other
columns take no part, whatever their names. Words of equal rarity are taken in ascending order; a word that stands twice in a template counts at its first place.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.durable import written

ANCHORS, SHARE = 4, 0.5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that make a label by themselves.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, int], ...]  # key phrase and its place


def templates(path: str | None = None) -> list[Template]:
    out = []
    for line in Path(path or Path(__file__).with_name("licence_templates.tsv")).read_text().splitlines():
        label, phrases, text = line.split("\t")
        words = tuple(w for w in re.split(GAP, text.lower()) if w)
        spaced = f" {' '.join(words)} "
        places = []
        for p in phrases.split("|"):
            if f" {p} " not in spaced:
                raise ValueError(f"key phrase {p} is not in the template of {label}")
            places.append((p, spaced[: spaced.index(f" {p} ")].count(" ")))
        out.append(Template(label, words, tuple(places)))
    return out


def words(text: str) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), GAP), lambda w: w != "")


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the vocabulary: as many numbers as the templates have words."""
    found = docs.select(F.explode(F.array_intersect(words(text_col), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return docs.count(), {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def weight(n: int, df: int) -> int:
    """A word's rarity in thousandths, at least 1."""
    return max(1, round(1000 * math.log((n + 1) / (df + 1))))


@dataclass(frozen=True)
class Posting:
    token: str  # a word, or a key phrase
    template: int
    at: int
    bit: int
    weight: int  # 0 for a phrase


def index(known: list[Template], n: int, df: dict[str, int]) -> list[Posting]:
    out = []
    for t, template in enumerate(known):
        ranked = sorted({w: (-weight(n, df.get(w, 0)), w) for w in template.words}.values())[:ANCHORS]
        out += [Posting(w, t, template.words.index(w), bit, -rank) for bit, (rank, w) in enumerate(ranked)]
        out += [Posting(p, t, at, ANCHORS + i, 0) for i, (p, at) in enumerate(template.phrases)]
    return out


def places(of: Column, joined: Column, phrase: str) -> Column:
    """Starts of a phrase in a file's words; words are only walked where the joined text has the phrase."""
    parts = phrase.split(" ")
    stands = lambda i: reduce(lambda a, b: a & b, [F.get(of, i + k) == p for k, p in enumerate(parts)])
    found = F.filter(F.transform(of, lambda w, i: F.when(stands(i), i)), lambda i: i.isNotNull())
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _tagged(of: Column, tokens: list[str], where: Column) -> Column:
    """(i, token) for phrases."""

    def found(token: str) -> Column:
        return F.transform(places(of, where, token), lambda i: F.struct(i.alias("i"), F.lit(token).alias("token")))

    return F.concat(*map(found, tokens))


def table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ``keep`` columns with lic_words, lic_base (places (i, token) of base phrases), lic_base_labels, lic_labels (both sorted) and lic_score, the greatest share of a template's weight (1 with a base phrase)."""
    spark = docs.sparkSession
    known = templates(path)
    found = index(known, *frequencies(docs, text_col, sorted({w for t in known for w in t.words})))
    rare = sorted({p.token for p in found if p.weight})
    phrases = sorted({p.token for p in found if not p.weight})
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("text"), words(text_col).alias("w"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    w, joined = F.col("w"), F.col("joined")
    some = F.arrays_overlap("w", F.array(*map(F.lit, rare)))
    single = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("token"))), lambda x: x["token"].isin(rare))
    none = F.array().cast("array<struct<i:int,token:string>>")
    rows = rows.withColumns({"base": _tagged(w, list(BASE), joined), "hits": F.when(some, F.concat(single, _tagged(w, phrases, joined))).otherwise(none)})
    label_of = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    rows = written(rows.select(*names, F.size("w").cast("long").alias("n"), "base", F.array_sort(F.array_distinct(F.transform("base", lambda b: label_of[b["token"]]))).alias("base_labels"), "hits", F.when(F.size("hits") > 0, F.sha2("text", 256)).alias("key")))
    posted = table(spark, [(p.token, p.template, p.at, p.bit) for p in found], "token", "t", "at", "bit")
    hit = rows.where("key is not null").select("key", F.explode("hits").alias("h")).select("key", "h.*").join(F.broadcast(posted), "token")
    # one row a posting of an alignment, then of the alignment; copies of a text fall together
    agreed = hit.groupBy("key", "t", (F.col("i") - F.col("at")).alias("start")).agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))
    of = [[p for p in found if p.template == t] for t in range(len(known))]
    whole = table(spark, [(t, x.label, sum(p.weight for p in of[t]), sum(1 << p.bit for p in of[t] if not p.weight), [p.weight for p in of[t] if p.weight]) for t, x in enumerate(known)], "t", "label", "total", "needed", "weights")
    agreed = agreed.join(F.broadcast(whole), "t").where(F.col("mask").bitwiseAND(F.col("needed")) == F.col("needed"))
    held = F.aggregate(F.transform("weights", lambda x, i: F.when(F.call_function("getbit", F.col("mask"), i) == 1, x).otherwise(0)), F.lit(0), lambda a, b: a + b)
    share = (held / F.col("total")).alias("share")
    labels = agreed.select("key", "label", share).where(F.col("share") >= SHARE).groupBy("key").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))
    with_hits = rows.where("key is not null").join(labels, "key", "left")
    without = rows.where("key is null").withColumns({"labels": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    every = with_hits.select(without.columns).unionByName(without)
    both = F.array_sort(F.array_union("base_labels", F.coalesce("labels", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return every.select(*names, "n", "base", "base_labels", both.alias("labels"), score.alias("score")).toDF(*keep, "lic_words", "lic_base", "lic_base_labels", "lic_labels", "lic_score")
