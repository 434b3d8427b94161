"""Prefix trie of conversations with a pointer-jumping rollup, in DataFrame functions.

Method. A node is a distinct sequence of first d turns, named by a digest. Digests of all prefixes are made by doubling: after round j, position i of a conversation has the digest of
the 2^j turns that end there (or of all turns so far), and the next round hashes it together with the one 2^j before. The shape of the hashing depends on the depth alone, so equal
prefixes have equal digests. Nodes are groups of (digest, depth); each one's parent edge is the digest one position earlier in the conversation of its smallest member. Leaf counts and
savings are then rolled up by pointer jumping: after round j a node holds the sums over its descendants at distances below 2^j and a pointer to its ancestor at
distance 2^j; descendants at distances 2^j to 2^(j+1) hang below nodes that point to it, so one grouped sum and one join double the distance. Rounds are logarithmic in the depth.

Scale. What is shuffled is slim: digests and counts, no texts. Positions in a conversation come from range partitions, so a conversation with a third of all turns spreads over
tasks; in each round only positions (nodes) deeper than the distance take part. A node that most conversations share is summed before it is shuffled, and joins on pointers are
plain equi-joins with one row on the right, which adaptive execution splits where the left is skewed. Members' ids are joined to pieces of at most PIECE_IDS ids
before a node's pieces stream into its digest.

Defined results. Null role or text is empty. Turns of one number are taken by role, then by the SHA-256 of their text; null turns stand first; repeated rows are as many turns. Rows with a
null conversation id take no part. Every depth is complete, however deep; texts may be of any length. An empty table has no nodes; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.durable import discard, written
from batchloom.llm.ordered import ordered_digests
from batchloom.operators.datastep import numbered

PIECE_IDS = 4096
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = "root"


def turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, i, x, words): each conversation's turns in order from 1, with a digest of role and text and the words of the text."""
    role, text = (F.coalesce(F.col(k), F.lit("")) for k in (role_col, text_col))
    slim = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), role.alias("role"), F.sha2(text, 256).alias("sha"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    placed = numbered(slim, ["c", F.col("t").asc_nulls_first(), "role", "sha"], "n")
    first = placed.groupBy("c").agg(F.min("n").alias("first"))
    digest = F.sha2(F.concat(F.sha2("role", 256), "sha"), 256)
    return placed.join(first, "c").select("c", (F.col("n") - F.col("first") + 1).alias("i"), digest.alias("x"), "words")


def with_bases(rows: DataFrame, base: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): every conversation c rebuilt as the first h turns of conversation ``base``, then its own turns after its first h. ``base`` and ``borrowed`` (h, at most
    ``most``) are expressions of c; a missing base gives no turns. ``conversations`` is (c, n): all of them with their rebuilt number of turns."""
    sizes = written(rows.groupBy("c").agg(F.count("*").alias("own")))
    has = sizes.select(F.col("c").alias("b"), F.col("own").alias("there"))
    plan = sizes.select("c", "own", base.alias("b"), borrowed.cast("long").alias("h")).join(has, "b", "left")
    plan = written(plan.select("c", "b", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("got")))
    own = rows.join(plan.select("c", "h", "got"), "c").where("i > h").select("c", (F.col("i") - F.col("h") + F.col("got")).alias("i"), "x", "words")
    lent = rows.where(F.col("i") <= most).withColumnRenamed("c", "b").join(plan.where("got > 0").select("c", "b", "got"), "b").where("i <= got").select("c", "i", "x", "words")
    return own.unionByName(lent), plan.select("c", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(rows: DataFrame, deepest: int) -> DataFrame:
    """(c, i, p, words): the digest of each conversation's first i turns, and the words of turn i."""
    now, distance = written(rows.select("c", "i", F.col("x").alias("p"), "words")), 1
    while distance < deepest:
        before = now.select("c", (F.col("i") + distance).alias("i"), F.col("p").alias("q"))
        far = now.where(F.col("i") > distance).join(before, ["c", "i"]).select("c", "i", F.sha2(F.concat("q", "p"), 256).alias("p"), "words")
        old, now = now, written(far.unionByName(now.where(F.col("i") <= distance)))
        discard(old)
        distance *= 2
    return now


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(digest, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; ``rows`` are (c, i, x, words), ``conversations`` (c, n)."""
    conversations = written(conversations)
    deepest = conversations.agg(F.max("n")).first()[0] or 0
    prefix = prefixes(rows, deepest)
    nodes = prefix.groupBy(F.col("p").alias("digest"), F.col("i").alias("depth")).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    up = prefix.select(F.col("c").alias("conv_id"), (F.col("i") + 1).alias("depth"), F.col("p").alias("parent"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    top = conversations.groupBy().agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("string").alias("parent"))
    nodes = written(nodes.unionByName(top))
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(below, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.join(above, "parent", "left"))
    leaf = (F.col("n_children") == 0).cast("long").alias("n_leaves")
    sums = rolled_up(nodes.select("digest", "depth", F.col("parent").alias("up"), leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), deepest)
    out = nodes.drop("words", "parent").join(sums, "digest").join(ends(prefix, conversations), "digest", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def rolled_up(state: DataFrame, deepest: int, totals: tuple[str, ...] = ("n_leaves", "saved_tokens")) -> DataFrame:
    """(digest, totals): sums over each node's subtree, from (digest, depth, up, totals) with ``up`` the parent (null for the root)."""
    distance, old = 1, None
    while distance <= deepest:
        given = state.where("up is not null").groupBy(F.col("up").alias("digest")).agg(*[F.sum(t).alias(f"{t}_given") for t in totals])
        jump = state.select(F.col("digest").alias("up"), F.col("up").alias("further"))
        far = state.where(F.col("depth") >= 2 * distance).join(jump, "up").drop("up").withColumnRenamed("further", "up")
        near = state.where(F.col("depth") < 2 * distance).withColumn("up", F.lit(None).cast("string"))
        moved = far.select(state.columns).unionByName(near).join(given, "digest", "left")
        state = written(moved.select("digest", "depth", "up", *[(F.col(t) + F.coalesce(f"{t}_given", F.lit(0))).alias(t) for t in totals]))
        if old is not None:
            discard(old)
        old, distance = state, 2 * distance
    return state.select("digest", *totals)


def ends(prefix: DataFrame, conversations: DataFrame) -> DataFrame:
    """(digest, ends_sha256): of the ids of the conversations that end in a node, ascending and joined by commas."""
    whole = prefix.join(conversations.withColumnRenamed("n", "i"), ["c", "i"]).select(F.col("p").alias("digest"), "c")
    whole = whole.unionByName(conversations.where("n = 0").select(F.lit(ROOT).alias("digest"), "c"))
    placed = numbered(whole, ["digest", "c"], "n").withColumn("piece", F.floor(F.col("n") / PIECE_IDS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = written(placed.groupBy("digest", "piece").agg(ids.alias("ids")))
    many = pieces.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    alone = pieces.join(many, "digest", "left_anti").select("digest", F.sha2("ids", 256).alias("ends_sha256"))
    return alone.unionByName(ordered_digests(pieces.join(many, "digest", "left_semi"), "digest", ["piece"], "ids", ",").toDF("digest", "ends_sha256"))
