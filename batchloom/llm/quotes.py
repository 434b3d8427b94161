"""Quotation linking with DataFrame functions only.

Each message's lines are parsed into a quote level (how many ``>`` lead the line) and the rest. A *passage* is a maximal run of lines
of one level, and also each single line; it is normalised (letters and digits, lower case, single spaces) and hashed. Own text has level 0.
A quoted passage's original is the earliest message of the same conversation, before the quoting turn, whose own text has a passage with that
hash. A message's parent is the original of its level-1 passages that covers most characters (ties: the later turn); deeper levels give the
other messages it quotes. Following parents gives the thread's root and the depth; a conversation in reply order is its rows
by (root_turn, depth, turn), with the own text as body: quotes and the attribution lines before them are gone.

Scale. Parsing is row-local (higher-order functions). Only passages that a bit set of the quoted ones cannot rule out are shuffled: originals are reduced to the least turn by
(conversation, hash) with a map-side combine, and joined to the quoted passages on that pair, so a hot conversation spreads over its
passages. Threads are resolved by pointer jumping over the quoting messages only, with lineage cut each round.

Defined results. Null or empty text: no passages, empty body. A null conv_id or turn takes no part in linking; such rows are returned with no parent.
A message that quotes nothing known is a root of depth 0. An empty table
gives no rows; columns named as the outputs (q_...) are replaced. Rows with the same conv_id, turn and text are one message and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.durable import id_filter, may_be_in, written
from batchloom.llm.textblocks import replaced

_LEAD = r"^(?:[ \t]{0,3}>)+[ \t]?"
_ATTRIBUTION = r"(?i)^(on\b.{1,200}\bwrote|.{1,200}\b(a écrit|schrieb|escribió))[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def lines(text: Column) -> Column:
    """Array of (level, rest) for the lines of a text."""

    def one(line: Column) -> Column:
        lead = F.regexp_extract(line, _LEAD, 0)
        return F.struct(F.length(F.regexp_replace(lead, "[^>]", "")).alias("level"), F.substring(line, F.length(lead) + 1, F.length(line)).alias("rest"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), one)


def runs(parsed: Column) -> Column:
    """Array of (level, text) of maximal runs of lines of one level."""
    at = F.sequence(F.lit(0), F.size(parsed) - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get(parsed, i)["level"] != F.get(parsed, i - 1)["level"]))
    stop = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(parsed)))
    return F.zip_with(first, stop, lambda a, b: F.struct(F.get(parsed, a)["level"].alias("level"), F.array_join(F.transform(F.slice(parsed, a + 1, b - a), lambda x: x["rest"]), "\n").alias("text")))


def parsed_messages(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with q_lines, q_runs, q_level (deepest) and q_body (own lines without attributions that lead into a quote)."""
    out = messages.withColumn("q_lines", lines(F.col(text_col)))
    out = out.withColumns({"q_runs": runs(F.col("q_lines")), "q_level": F.array_max(F.transform("q_lines", lambda x: x["level"]))})
    q = F.col("q_lines")

    def own(x: Column, i: Column) -> Column:
        after = F.get(q, i + 1)["level"]
        return (x["level"] == 0) & ~(F.coalesce(after > 0, F.lit(False)) & x["rest"].rlike(_ATTRIBUTION))

    return out.withColumn("q_body", F.trim(F.array_join(F.transform(F.filter(q, own), lambda x: x["rest"]), "\n"), F.lit(" \t\n\r")))


def _passages(parsed: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, level, hash, n): normalised passages, runs and single lines. Those that a message repeats fall together in the aggregations that follow."""
    every = F.concat("q_runs", F.transform("q_lines", lambda x: F.struct(x["level"].alias("level"), x["rest"].alias("text"))))
    clean = F.transform(every, lambda x: F.struct(x["level"].alias("level"), normalised(x["text"]).alias("text")))
    out = parsed.select(*key, F.explode(F.filter(clean, lambda x: x["text"] != "")).alias("x"))
    return out.select(*key, F.col("x.level").alias("level"), F.sha2("x.text", 256).alias("hash"), F.length("x.text").alias("n"))


def linked_passages(parsed: DataFrame) -> DataFrame:
    """(c, t, m, level, n, source): quoted passages with the turn of their original. Expects columns c, t, m (conversation, turn, message hash)."""
    quoting = parsed.where(F.col("q_level") > 0)
    quoted = _passages(quoting, ["c", "t", "m"]).where("level > 0").distinct()  # repeated rows are one message
    wanted = quoted.select("c", "hash").distinct()
    pair = F.xxhash64("c", "hash")
    own = _passages(parsed, ["c", "t"]).where("level = 0").withColumn("pair", pair)
    own = may_be_in(own, "pair", id_filter(written(wanted.select(pair.alias("pair"))), "pair"), "quoted").where("quoted")  # passages that nobody quotes stay where they are
    own = own.groupBy("c", "hash").agg(F.min("t").alias("source"))
    return quoted.join(own, ["c", "hash"]).where("source < t").select("c", "t", "m", "level", "n", "source")


def threads(parents: DataFrame) -> DataFrame:
    """(c, t, root, depth) from (c, t, parent), by pointer jumping."""
    state = written(parents.groupBy("c", "t").agg(F.min("parent").alias("up")).withColumn("depth", F.lit(1)))
    while True:
        above = state.select("c", F.col("t").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = written(state.join(above, ["c", "up"], "left").select("c", "t", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        more = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not more:
            return state.withColumnRenamed("up", "root")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """All rows and columns with q_level, q_passages (linked), q_sources (turns quoted, sorted), q_parent, q_root, q_depth and q_body."""
    messages = replaced(messages, "q_level", "q_passages", "q_sources", "q_parent", "q_root", "q_depth", "q_body")
    own = messages.columns
    names = [f"c{i}" for i in range(len(own))]
    conv, turn, text = (names[own.index(c)] for c in (conv_col, turn_col, text_col))
    key = {"c": F.col(conv), "t": F.col(turn).cast("long"), "m": F.xxhash64(text)}
    rows = parsed_messages(messages.toDF(*names), text).withColumns(key)
    whole = rows.where(F.col("c").isNotNull() & F.col("t").isNotNull())
    links = linked_passages(whole.select("c", "t", "m", "q_lines", "q_runs", "q_level"))
    cover = links.groupBy("c", "t", "m", "source").agg(F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("n"), F.count("*").alias("k"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", "source")))
    found = written(cover.groupBy("c", "t", "m").agg(F.sum("k").alias("q_passages"), F.array_sort(F.collect_set("source")).alias("q_sources"), best["source"].alias("q_parent")))
    order = threads(found.where("q_parent is not null").select("c", "t", F.col("q_parent").alias("parent")))
    out = rows.join(found, ["c", "t", "m"], "left").join(order, ["c", "t"], "left")
    return out.select(
        *names, "q_level", F.coalesce("q_passages", F.lit(0)).alias("q_passages"), F.coalesce("q_sources", F.array().cast("array<bigint>")).alias("q_sources"),
        "q_parent", F.coalesce("root", "t").alias("q_root"), F.coalesce("depth", F.lit(0)).alias("q_depth"), "q_body",
    ).toDF(*own, "q_level", "q_passages", "q_sources", "q_parent", "q_root", "q_depth", "q_body")


def in_reply_order(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations in reply order (a range-partitioned sort), quotes removed."""
    return linked.orderBy(conv_col, "q_root", "q_depth", turn_col)
