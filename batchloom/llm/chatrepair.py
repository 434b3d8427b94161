"""Conversation structure repair by weighted finite-state composition.

Method. Three machines are composed lazily, arc by arc as the search asks for them: the *input acceptor* spells a conversation's messages, one symbol each (the
role's initial and the message's fault); the *edit transducer* keeps, re-roles or deletes a message and inserts messages, each at a cost; the *grammar
acceptor* allows the role initials ``(s?(ua)+)?``. The best path is the shortest one over the weights (cost, label string), ordered by cost, then by the string. This
order is kept when a label is put *before* two strings, not after them, so distances run backwards, from the final states, along the topological order of the composed
machine. An inserted message stands in the machine's own position: more than two in a row lead back to a grammar state at a higher cost, so the transducer
stops at two and the composed machine has no cycle. Each label leaves a composed state for one other state, so the first label decides between
equal costs and no string is stored.

Scale. Copies of one message in one place are counted first. Messages are range-partitioned by (conversation, turn, ...) and cut into *segments* of at most SEGMENT_ROWS
messages and SEGMENT_BYTES of text, one row each, which are written. A conversation in one segment is solved there. For longer ones every segment gives its
4 x 4 matrix of costs (grammar state in, grammar state out); these go backwards through a stream that keeps four numbers, which gives each segment its distances to the end,
then forwards, which gives each the state it starts in. So a conversation with a third of all rows is solved by as many tasks as it has segments.

Defined results. Nulls in any column read as one space; a null conversation id is a conversation of its own. Messages of one turn are taken by role, then by the SHA-256 of their text; null turns
stand first. Repeated rows are as many messages, all but the first of which are duplicates. Texts may be of any length. An empty table gives no
rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.durable import id_filter, may_be_in, written
from batchloom.llm.ordered import ordered_digests

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20
INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
NAMES = {"u": "user", "a": "assistant"}
#: The grammar's arcs by state: initial to next state. State 0 starts, 1 has seen s, 2 u, 3 a.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
STATES = len(GRAMMAR)
_INSERTS = 2
_FAR = 1 << 60


def symbol(initial: str, fault: int) -> int:
    """The input symbol of a message; every initial outside the grammar is one symbol."""
    return (INITIALS.find(initial) if initial else -1) % 4 * 4 + fault


def edits(code: int):
    """Arcs of the edit transducer that read a symbol: (label, cost, initial written or None)."""
    initial, fault = code // 4, code % 4
    yield "D", DELETE, None
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if initial < len(INITIALS):
            yield "K", KEEP + more, INITIALS[initial]
        for r in NAMES:
            yield "R", REROLE + more, r


@lru_cache(None)
def reading(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """Composed arcs that read a symbol: (label, cost, next grammar state), least label first."""
    found = [(label, cost, state if r is None else GRAMMAR[state].get(r)) for label, cost, r in edits(code)]
    return tuple(sorted((label, cost, to) for label, cost, to in found if to is not None))


@lru_cache(None)
def writing(state: int) -> tuple[tuple[str, int, int], ...]:
    """Composed arcs that read nothing: insertions."""
    return tuple(("I", INSERT, to) for r, to in GRAMMAR[state].items() if r in NAMES)


def layer(code: int | None, after: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[tuple]]:
    """Costs and best arcs of the states (inserted, grammar state) before a symbol, from the costs after it; without a symbol, at the end (``after``: of stopping there)."""
    costs, arcs = [], []
    for inserted in reversed(range(_INSERTS + 1)):
        row, best = [], []
        for g in range(STATES):
            if code is None:
                found = [(after[g], "", g, False)]
            else:
                found = [(cost + after[to], label, to, True) for label, cost, to in reading(code, g)]
            if inserted < _INSERTS:
                found += [(cost + costs[0][to], label, to, False) for label, cost, to in writing(g)]
            first = min(found)
            row.append(min(first[0], _FAR))
            best.append(first[1:])
        costs.insert(0, tuple(row))
        arcs.insert(0, best)
    return costs, arcs


_layer = lru_cache(1 << 16)(layer)


def at_end() -> tuple[int, ...]:
    """Distances of the grammar states from the end, where no message is left."""
    return tuple(layer(None, tuple(0 if g in FINAL else _FAR for g in range(STATES)))[0][0])


def distances(codes: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    """Distances before a run of symbols, from those after it."""
    for code in reversed(codes):
        after = _layer(code, after)[0][0]
    return after


def matrix(codes: bytes) -> list[int]:
    """Least cost from each grammar state to each through a run of symbols, row by row."""
    columns = [distances(codes, tuple(0 if g == end else _FAR for g in range(STATES))) for end in range(STATES)]
    return [columns[end][g] for g in range(STATES) for end in range(STATES)]


def path(codes: bytes, after: tuple[int, ...], state: int, last: bool) -> tuple[list[tuple[int, str, str]], int]:
    """The best path through a run from a grammar state: (place, label, initial written) for each edit, and the state it ends in. After the ``last`` run the end's insertions follow."""
    layers = []
    if last:
        costs, arcs = layer(None, tuple(0 if g in FINAL else _FAR for g in range(STATES)))
        layers.append(arcs)
        after = costs[0]
    for code in reversed(codes):
        costs, arcs = _layer(code, after)
        layers.append(arcs)
        after = costs[0]
    out: list[tuple[int, str, str]] = []
    for place, arcs in enumerate(reversed(layers)):
        inserted = 0
        while True:
            label, to, read = arcs[inserted][state]
            if not label:
                break
            initial = "" if label == "D" else next(r for r, g in GRAMMAR[state].items() if g == to and (label == "K" or r in NAMES))
            out.append((place, label, initial))
            state = to
            if read:
                break
            inserted += 1
    return out, state


def illegal(codes: bytes) -> int:
    """Adjacent pairs of initials that are not su, ua or au."""
    x = np.frombuffer(codes, np.uint8) // 4
    pair = x[:-1] * 4 + x[1:]
    return int(len(pair) - np.isin(pair, [1, 6, 9]).sum())


_SEGMENT = "c string, conv_id {kind}, block int, seg int, codes binary, places array<int>, roles array<string>, texts array<string>, least bigint, most bigint, turns bigint"


def _segments(kind: pa.DataType, most_rows: int, most_bytes: int):
    """Sorted rows (c, conv_id, block, t, role, text, fault, n) to rows of _SEGMENT. All but the first of n copies are duplicates; texts that must go are not kept."""

    def made(rows: list) -> pa.RecordBatch:
        names = ["c", "conv_id", "block", "seg", "codes", "places", "roles", "texts", "least", "most", "turns"]
        kinds = [pa.string(), kind, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def each(batches):
        here, seg, out = None, 0, []  # (c, conversation, block), number of the open segment, closed segments
        codes, places, roles, texts, turns = bytearray(), [], [], [], []
        held = size = 0  # bytes of text in the open segment, and since the last batch went out

        def close():
            nonlocal codes, places, roles, texts, turns, held, seg
            known = [t for t in turns if t is not None]
            out.append((*here, seg, bytes(codes), places, roles, texts, *((known[0], known[-1], len(set(known))) if known else (None, None, 0))))
            codes, places, roles, texts, turns, held, seg = bytearray(), [], [], [], [], 0, seg + 1

        for b in batches:
            for c, conv, block, t, role, text, fault, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if here != (c, conv, block):
                    if codes:
                        close()
                    here, seg = (c, conv, block), 0
                for copy in range(n):
                    f = fault if copy == 0 or fault == 1 else 2
                    if codes and (len(codes) >= most_rows or held + len(text) > most_bytes):
                        close()
                    if f not in (1, 2):
                        places.append(len(codes))
                        roles.append(role)
                        texts.append(text)
                        held += len(text)
                        size += len(text)
                    codes.append(symbol(role[:1], f))
                    turns.append(t)
                    if len(out) >= SEGMENT_ROWS or size > most_bytes and out:
                        yield made(out)
                        out, size = [], held
        if codes:
            close()
        if out:
            yield made(out)

    return each


def _matrices(batches):
    for b in batches:
        m = [matrix(x) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(m, pa.list_(pa.int64()))], ["c", "block", "seg", "m"])


def _back(batches):
    """(c, block, seg, matrix), the last segment of a conversation first, to (c, block, seg, after, last): distances after each segment."""
    key, now = None, at_end()
    for b in batches:
        rows = []
        for c, block, seg, m in zip(*(x.to_pylist() for x in b.columns), strict=True):
            last = c != key
            if last:
                key, now = c, at_end()
            rows.append((c, block, seg, list(now), last))
            now = tuple(min(min(m[g * STATES + e] + now[e] for e in range(STATES)), _FAR) for g in range(STATES))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()], strict=True)], ["c", "block", "seg", "after", "final"])


def _exits(batches):
    """(c, block, seg, codes, after) to (c, block, seg, ends): the state that the best path through a segment ends in, for each state it may start in."""
    for b in batches:
        rows = [(c, block, seg, [path(codes, tuple(after), g, False)[1] if distances(codes, tuple(after))[g] < _FAR else g for g in range(STATES)]) for c, block, seg, codes, after in zip(*(x.to_pylist() for x in b.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())], strict=True)], ["c", "block", "seg", "ends"])


def _forth(batches):
    """(c, block, seg, ends) in order to (c, block, seg, state): the grammar state each segment starts in."""
    key, now = None, 0
    for b in batches:
        rows = []
        for c, block, seg, ends in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if c != key:
                key, now = c, 0
            rows.append((c, block, seg, now))
            now = ends[now]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["c", "block", "seg", "state"])


_SOLVED = "cr_counts struct<rows:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,first:int,last:int>, cr_cost bigint, cr_audit string, cr_messages array<struct<role:string,text:string>>"


def _solve(batches):
    """Adds the best path's cost, labels and messages to segments (columns codes, places, roles, texts, after, state, final first)."""
    for b in batches:
        counts, costs, audits, messages = [], [], [], []
        for codes, places, roles, texts, after, state, final in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            end = at_end() if after is None else tuple(after)
            steps, _ = path(codes, end, state, final)
            text_at = {p: i for i, p in enumerate(places)}
            faults = np.bincount(np.frombuffer(codes, np.uint8) % 4, minlength=4)
            counts.append({"rows": len(codes), "blank": int(faults[1]), "duplicate": int(faults[2]), "truncated": int(faults[3]), "illegal": illegal(codes), "first": codes[0] // 4, "last": codes[-1] // 4})
            spent, said = 0, []
            for place, label, initial in steps:
                if label == "I":
                    spent += INSERT
                    said.append({"role": NAMES[initial], "text": ""})
                elif label == "D":
                    spent += DELETE
                else:
                    spent += (REROLE if label == "R" else KEEP) + (TRUNCATED if codes[place] % 4 == 3 else 0)
                    at = text_at[place]
                    said.append({"role": NAMES[initial] if label == "R" else roles[at], "text": texts[at]})
            costs.append(spent)
            audits.append("".join(label for _, label, _ in steps))
            messages.append(said)
        kinds = {"cr_counts": pa.struct([("rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])}
        said = pa.array(messages, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
        yield pa.RecordBatch.from_arrays([*b.columns[7:], pa.array(counts, kinds["cr_counts"]), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), said], [*b.schema.names[7:], "cr_counts", "cr_cost", "cr_audit", "cr_messages"])


def _fault(text: Column, later: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(" \t\n\v\f\r")), F.lit(1))
    return F.when(last == "", 1).when(later, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each segment, in order of (block, seg) within a conversation: ``conv_id, block, seg, cr_single`` (the conversation has no other), the turns' bounds,
    ``cr_counts`` of rows, faults and illegal pairs, and the best edits' ``cr_cost``, ``cr_audit`` and repaired ``cr_messages``."""
    spark = messages.sparkSession
    c = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit(" "))
    space = [F.coalesce(F.col(x), F.lit(" ")) for x in (role_col, text_col)]
    rows = messages.select(c.alias("c"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("t"), space[0].alias("role"), space[1].alias("text"))
    rows = rows.groupBy("c", "conv_id", "t", "role", "text").agg(F.count("*").alias("n")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("pair", F.xxhash64("c", "role", "sha"))
    turn = F.struct(F.col("t").isNotNull().alias("known"), "t")
    again = rows.groupBy("c", "role", "sha", "pair").agg(F.min(turn).alias("earliest"), F.count("*").alias("k")).where("k > 1").drop("k")
    again = written(again)  # messages that come back in another turn
    seen = may_be_in(rows, "pair", id_filter(again, "pair"), "hit")
    none = F.lit(False)
    back = seen.where("hit").join(again.drop("pair"), ["c", "role", "sha"], "left").withColumn("later", F.coalesce(F.col("earliest") < turn, none)).drop("earliest")
    rows = seen.where("not hit").withColumn("later", none).unionByName(back).withColumn("fault", _fault(F.col("text"), F.col("later")))
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("role"), F.col("sha")]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    kind = messages.select(F.col(conv_col).alias("conv_id")).schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    segments = ranged.select("c", "conv_id", "block", "t", "role", "text", "fault", "n").mapInArrow(_segments(to_arrow_type(kind), segment_rows, segment_bytes), _SEGMENT.format(kind=kind.simpleString()))
    segments = written(segments)
    # conversations with several segments
    long = written(segments.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c", F.xxhash64("c").alias("h")))
    segments = may_be_in(segments.withColumn("h", F.xxhash64("c")), "h", id_filter(long, "h"), "hit").drop("h")
    parts = segments.where("hit").drop("hit").join(long.drop("h"), "c", "left_semi")
    alone = segments.where("hit").join(long.drop("h"), "c", "left_anti").unionByName(segments.where("not hit")).drop("hit")
    alone = alone.withColumns({"after": F.lit(None).cast("array<bigint>"), "state": F.lit(0), "final": F.lit(True), "cr_single": F.lit(True)})
    key = ["c", "block", "seg"]
    costs = parts.select(*key, "codes").mapInArrow(_matrices, "c string, block int, seg int, m array<bigint>")
    after = written(costs.repartition("c").sortWithinPartitions("c", F.desc("block"), F.desc("seg")).mapInArrow(_back, "c string, block int, seg int, after array<bigint>, final boolean"))
    ends = parts.select(*key, "codes").join(after, key).select(*key, "codes", "after").mapInArrow(_exits, "c string, block int, seg int, ends array<int>")
    state = ends.repartition("c").sortWithinPartitions(*key).mapInArrow(_forth, "c string, block int, seg int, state int")
    several = parts.join(after, key).join(state, key).withColumn("cr_single", F.lit(False))
    first = ["codes", "places", "roles", "texts", "after", "state", "final"]
    rest = ["c", "conv_id", "block", "seg", "cr_single", "least", "most", "turns"]
    every = alone.select(*first, *rest).unionByName(several.select(*first, *rest))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in every.select(*rest).schema)
    return every.mapInArrow(_solve, f"{kinds}, {_SOLVED}")


def report(repaired: DataFrame) -> DataFrame:
    """(c, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row a conversation, from the rows of ``repair``. ``audit`` is a text as long as the conversation."""
    counted = ["blank", "duplicate", "truncated", "illegal"]
    whole = repaired.select("c", "conv_id", "block", "seg", "cr_single", "least", "most", "turns", "cr_counts.*", F.col("cr_cost").alias("cost"), F.col("cr_audit").alias("audit"))
    alone = whole.where("cr_single").select("c", "conv_id", "least", "most", "turns", *counted, "cost", "audit")
    w = Window.partitionBy("c").orderBy("block", "seg")
    met = (F.lag("last").over(w) * 4 + F.col("first")).isin(1, 6, 9)  # two segments of one conversation meet in a legal pair
    parts = whole.where("not cr_single").withColumns({"illegal": F.col("illegal") + F.coalesce((~met).cast("int"), F.lit(0)), "turns": F.col("turns") - F.coalesce((F.lag("most").over(w) == F.col("least")).cast("int"), F.lit(0))})
    sums = [F.sum(x).alias(x) for x in ("turns", *counted, "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seg", "audit"))), lambda x: x["audit"]), "").alias("audit")
    joined = parts.groupBy("c", "conv_id").agg(F.min("least").alias("least"), F.max("most").alias("most"), *sums, audit).select(alone.columns)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return alone.unionByName(joined).select("c", "conv_id", gaps, *counted, "cost", "audit")


def repaired_messages(repaired: DataFrame) -> DataFrame:
    """(conv_id, block, seg, place, role, text): the repaired messages; (block, seg, place) is their order in a conversation."""
    return repaired.select("conv_id", "block", "seg", F.posexplode("cr_messages").alias("place", "m")).select("conv_id", "block", "seg", "place", "m.*")


def digests(repaired: DataFrame) -> DataFrame:
    """(c, sha256) of each conversation's repaired ``role:text``, joined by newlines. Conversations of one segment are hashed where they are."""
    lines = F.array_join(F.transform("cr_messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    pieces = repaired.select("c", "block", "seg", "cr_single", F.size("cr_messages").alias("n"), lines.alias("piece"))
    alone = pieces.where("cr_single").select("c", F.sha2("piece", 256).alias("sha256"))
    several = ordered_digests(pieces.where("not cr_single and n > 0"), "c", ["block", "seg"], "piece", "\n")
    return alone.unionByName(several.toDF("c", "sha256"))
