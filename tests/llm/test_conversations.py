"""Conversation repair and the prefix trie against brute force, with nulls, ties, repeated rows, hot conversations and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from batchloom.llm import chatrepair, chattrie

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    """Rows of each conversation by turn (null first), role and the text's digest, nulls as one space."""
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2]))) for c, x in out.items()}


def repaired_by_search(rows):
    """(cost, labels, lines) by Dijkstra over (row, grammar state) with whole label strings."""
    import heapq

    seen, marked = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
        seen.add((role, text))
        marked.append((role, text, fault))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, labels, i, g, lines = heapq.heappop(heap)
        if (i, g, labels) in done:
            continue
        done.add((i, g, labels))
        if i == len(marked) and g in (0, 3):
            return cost, labels, list(lines), [m[2] for m in marked]
        moves = [("I", 3, i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(marked):
            role, text, fault = marked[i]
            moves.append(("D", 4, i + 1, None, None))
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                moves += [("K", more, i + 1, role, (role, text))] + [("R", 3 + more, i + 1, r, (r, text)) for r in ("user", "assistant")]
        for label, price, j, role, line in moves:
            to = g if role is None else {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((g, role[:1]))
            if to is not None and len(labels) < 2 * len(marked) + 4:
                heapq.heappush(heap, (cost + price, labels + label, j, to, lines if line is None else (*lines, line)))
    raise AssertionError("no path")


def expected(rows):
    out = {}
    for c, x in in_order(rows).items():
        cost, labels, lines, faults = repaired_by_search(x)
        turns = [t for t, _, _ in x if t is not None]
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(x))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), bad, cost, labels, sha("\n".join(f"{r}:{t}" for r, t in lines)))
    return out


def repaired(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit("mine"), "block": F.lit(1), "cr_cost": F.lit("x"), "pair": F.lit(0)})
    done = chatrepair.repair(df, **limits)
    found = chatrepair.report(done).join(chatrepair.digests(done), "c", "left")
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or sha("")) for r in found.collect()}, done


def messy(seed, conversations, most=7):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \t", None, "A longer one?\n", "so. ", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys"]
    return [(c if c else None, r.choice([None, *range(5)]), r.choice(roles), r.choice(texts)) for c in range(conversations) for _ in range(r.randint(1, most))]


def test_repair_matches_a_search_over_whole_label_strings(spark):
    rows = messy(1, 60) + [(500, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(6)]
    got, _ = repaired(spark, rows)
    assert got == expected(rows)


def test_repair_of_conversations_in_many_segments(spark):
    """Segments of three messages: matrices, both streams, pairs and turns across segments, digests of several pieces."""
    rows = messy(2, 12, 9) + [(900, i // 2, ("user", "assistant", "system", "user")[i % 4], f"Text {i % 11}" + "."[: i % 3]) for i in range(14)]
    got, _ = repaired(spark, rows, segment_rows=3)
    assert got == expected(rows)
    tiny, _ = repaired(spark, rows, segment_bytes=5)
    assert tiny == got


def test_repair_of_a_hot_conversation_and_of_copies(spark):
    """A conversation of 3,000 messages in segments is what one segment gives; 2,500 copies of one message are one message and duplicates."""
    rows = [(1, i, ("user", "assistant", "user")[i % 3], f"Word {i}" + ("." if i % 5 else "")) for i in range(3000)] + [(2, 0, "user", "Same.")] * 2500
    whole, _ = repaired(spark, rows, segment_rows=1 << 20)
    parts, done = repaired(spark, rows, segment_rows=100)
    assert whole == parts and parts[2][:7] == (0, 0, 2499, 0, 2499, 4 * 2499 + 3, "K" + "D" * 2499 + "I") and done.where("c = 'c1'").count() >= 30
    lines = [r.role[0] for r in chatrepair.repaired_messages(done).where("conv_id = 1").orderBy("block", "seg", "place").collect()]
    assert re.fullmatch("(ua)+", "".join(lines))


def test_repair_of_nothing_and_of_a_very_long_text(spark):
    assert repaired(spark, [])[0] == {}
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 500_000)]
    got, _ = repaired(spark, rows, segment_bytes=1000)
    assert got == expected(rows)


# prefix trie
def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:])
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) for n in below)
        last = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), leaves, saved, sha(last)))
    return sorted(out, key=str)


def nodes_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit("mine"), "i": F.lit(1), "depth": F.lit("x"), "words": F.lit(0)})
    c = F.col("c")
    made = chattrie.with_bases(chattrie.turns(df), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in chattrie.trie(*made).select(*names).collect()), key=str)


def test_trie_matches_brute_force(spark):
    r = random.Random(5)
    texts = ["a b c", "d", "", None, "e  f\n"]
    rows = [(r.randrange(20, 70), r.choice([None, *range(4)]), r.choice(["user", None, "assistant"]), r.choice(texts)) for _ in range(200)]
    rows += [(c, t, "user", "hello there") for c in (0, 1, 2, 40, 41, -3) for t in range(3)] + [(None, 0, "user", "x"), (307, 0, "user", "alone")]
    assert nodes_of(spark, rows) == brute_trie(rows)


def test_trie_of_a_deep_conversation_and_of_many_copies(spark, monkeypatch):
    """Depth 150 next to a first turn that most conversations share; ends of one node in several pieces."""
    monkeypatch.setattr(chattrie, "PIECE_IDS", 7)
    rows = [(5, t, "user", f"turn {t}") for t in range(150)] + [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(2)] + [(c, 0, "user", "turn 0") for c in range(200, 240)]
    got = nodes_of(spark, rows)
    assert got == brute_trie(rows) and max(n[1] for n in got) >= 147


def test_trie_of_nothing(spark):
    assert nodes_of(spark, []) == [] and nodes_of(spark, [(None, 1, "user", "x")]) == []
    assert [n[:6] for n in nodes_of(spark, [(307, 0, "user", "x")])] == [(307, 0, None, 1, 0, 1)] if zlib.crc32(b"307") % 4 else True
