"""The training-data operators against brute force on small fixtures with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import json
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchloom.llm import contamination, durable, idcoder, jaccard, langid, packing, pieces, quotes, superkmers, textblocks, tokenfiles, toxicity, urlfilter, vafile
from batchloom.llm.textblocks import Words, shingle_sets, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"key": F.lit("x"), "a": F.lit(1), "id": F.lit(7), "component": F.lit(0), "spans": F.lit("s")}) if extra else df


def prose(seed, n, words=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, words, n))


# shared kernels
@given(st.lists(st.text(alphabet="aB é\t\n\u00a0▁x", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_match_the_pattern(texts):
    w = Words([t.encode() for t in texts], lower=True)
    got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(lower(t))]
    assert np.diff(w.first).tolist() == [len(WORD.findall(t)) for t in texts]
    h = w.hashes()
    assert len({(g, int(x)) for g, x in zip(got, h, strict=True)}) == len(set(got)) == len(set(h.tolist()))


def test_pack_round_trip():
    parts = [np.arange(5, dtype=np.int64), b"text", np.zeros(0, np.int32)]
    a, b, c = packing.unpack(packing.pack(*parts), "int64", "bytes", "int32")
    assert a.tolist() == [0, 1, 2, 3, 4] and b == b"text" and len(c) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.id: r.component for r in durable.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert durable.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 quotation linking
MAIL = [
    (1, 0, "user", "Hello there, world!\nSecond line."), (1, 1, "assistant", "On Monday A wrote:\n> hello THERE world\n\nMy answer"), (1, 2, "user", "> > Hello there, world!\n> My answer\nThanks"), (1, 3, "user", "> nothing known\nnew"),
    (1, 4, "user", ">> hello there world\nother"), (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", "> x"), (None, 0, "user", "> Hello there, world!"), (1, 2, "user", "> > Hello there, world!\n> My answer\nThanks"),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(9))
    out = {(r.conv_id, r.turn): r for r in quotes.link_quotations(df).collect()}
    assert quotes.link_quotations(df).count() == len(MAIL)
    r = out[(1, 1)]
    assert (r.q_parent, r.q_root, r.q_depth, r.q_body) == (0, 0, 1, "My answer")
    r = out[(1, 2)]
    assert (r.q_level, r.q_parent, r.q_root, r.q_depth, r.q_sources, r.q_body) == (2, 1, 0, 2, [0, 1], "Thanks")
    assert (out[(1, 3)].q_parent, out[(1, 3)].q_root, out[(1, 3)].q_body) == (None, 3, "new")
    assert (out[(1, 4)].q_parent, out[(1, 4)].q_sources) == (None, [0])
    assert out[(2, 0)].q_body == "" and out[(None, 0)].q_parent is None
    order = [r.turn for r in quotes.in_reply_order(quotes.link_quotations(df.where("conv_id = 1"))).collect()]
    assert order == [0, 1, 2, 2, 3, 4]
    assert quotes.link_quotations(df.limit(0)).count() == 0


def test_quotation_linking_of_a_hot_conversation(spark):
    """One conversation of many turns, a very long message, and columns that bear the outputs' names."""
    rows = [(1, i, "user", f"line {i} of this\n" + (f"> line {i - 1} of this" if i else "")) for i in range(200)] + [(2, 0, "user", "word " * 30_000), (2, 1, "user", "> " + "word " * 30_000 + "\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"q_parent": F.lit("mine"), "Q_BODY": F.lit("mine")})
    out = {(r.conv_id, r.turn): r for r in quotes.link_quotations(df).collect()}
    assert all(out[1, i].q_parent == i - 1 and out[1, i].q_root == 0 and out[1, i].q_depth == i for i in range(1, 200))
    assert out[2, 1].q_parent == 0 and out[2, 1].q_body == "yes" and len(out) == len(rows)


def test_quotation_linking_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from batchloom.llm.queries import oracle_sql

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(MAIL, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT * FROM frame")
    want = con.execute(f"SELECT conv_id, turn, max_level, n_linked, parent_turn, root_turn, depth, body_sha256 FROM ({oracle_sql()['op1_quotation_linking']})").fetchall()
    out = quotes.link_quotations(spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string"))
    got = out.select("conv_id", "turn", "q_level", "q_passages", "q_parent", "q_root", "q_depth", F.sha2("q_body", 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_quotation_plan_is_native(spark):
    df = spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string")
    plan = quotes.link_quotations(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 language identification
def test_language_identification(spark):
    r = np.random.default_rng(0)
    stems = {"aa": ["the", "and", "ing", "wh"], "bb": ["der", "ung", "sch", "ei"], "cc": ["que", "eau", "é", "ai"]}
    rows = [(int(i * 3 + k), " ".join("".join(r.choice(s, 3)) for _ in range(30)), lang) for i in range(60) for k, (lang, s) in enumerate(stems.items())]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([(1, "theandwhing andthe", "q"), (2, "derschung eiung", "q"), (3, None, "q"), (4, "12 !?", "q"), (5, "", "q"), (6, "ÉAI queeau", "q"), (7, "xxxx zzzz kkkk jjjj", "q")], "doc_id long, text string, lid_text string")
    out = {r.doc_id: r for r in langid.identify(test, model).collect()}
    assert [out[i].lid_lang for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "cc"]
    assert all(0 <= r.lid_score <= 1 for r in out.values()) and out[7].lid_rejected
    assert langid.fit(train.limit(0)) is None and langid.identify(test, None).where("lid_lang <> 'und'").count() == 0
    held = langid.identify(train, model)
    assert held.where("lid_lang = lang").count() > 0.98 * len(rows) and held.where("lid_rejected").count() < 0.05 * len(rows)


def brute_cosines(model, text):
    """Cosines with all centroids, from n-grams counted one by one in Python."""
    letters = [c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in b" " + text.encode() + b" "]
    a = [c for i, c in enumerate(letters) if not i or c != 32 or letters[i - 1] != 32]
    total, m = {}, 2**32
    for i in range(len(a) if len(a) > 2 else 0):
        slots = [(a[i] * 0x165667B1 % m) >> 20]
        if i + 1 < len(a):
            two = (a[i] * 0x9E3779B1 + a[i + 1] * 0x85EBCA6B) % m
            slots.append(two >> 20)
        if i + 2 < len(a):
            three = (two * 0xC2B2AE35 + a[i + 2] * 0x27D4EB2F + 7) % m
            slots.append((three ^ three >> 15) * 0x2C1B3C6D % m >> 20)
        for s in slots:
            total[s] = total.get(s, 0) + 1
    v = {s: np.log1p(n) * float(model.idf[s]) for s, n in total.items()}
    norm = sum(x * x for x in v.values()) ** 0.5 or 1
    return [sum(x * float(c[s]) for s, x in v.items()) / norm for c in model.centroids]


def test_language_prediction_matches_brute_force(spark):
    """Very long texts, ties (two languages with the same texts), repeated rows and clashing names too."""
    rows = [(i, prose(i % 40, 25, 60) if i % 3 else prose(i % 40, 25, 30).replace("w", "é"), "ab"[i % 3 == 0]) for i in range(120)]
    rows += [(200 + i, t, "c") for i, (_, t, lang) in enumerate(rows) if lang == "b"] + [(300, prose(1, 60_000), "a")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, t) for i, (_, t, _) in enumerate(rows[:25])] + [(30, prose(7, 50_000)), (31, "É w1 x"), (32, "z"), (32, "z"), (33, None), (34, "..")]
    out = langid.identify(spark.createDataFrame(test, "doc_id long, text string").withColumn("LID_SCORE", F.lit("mine")), model).collect()
    for r in out:
        if not r.text or not re.search(r"\w", r.text):
            assert (r.lid_lang, r.lid_score, r.lid_rejected) == ("und", 0, False)
            continue
        cosines = brute_cosines(model, r.text.lower())
        assert r.lid_score == pytest.approx(max(0, max(cosines)), abs=1e-4)
        assert max(c for c, o in zip(cosines, model.owner, strict=True) if model.langs[o] == r.lid_lang) == pytest.approx(max(cosines), abs=1e-4)
        assert r.lid_lang != "c"  # as near as b, which sorts first


def test_language_sample_counts_copies_once(spark, monkeypatch):
    fitted, k_means = [], langid.k_means
    monkeypatch.setattr(langid, "FIT_PER_LANG", 10)
    monkeypatch.setattr(langid, "k_means", lambda v, k: (fitted.append(v.shape[0]), k_means(v, k))[1])
    langid.fit(spark.createDataFrame([(i, prose(i % 12, 20), "aa") for i in range(240)], "doc_id long, text string, lang string"))
    assert fitted == [10]


# 3 SentencePiece
def best_score(p, unit):
    best = [0.0]
    for e in range(1, len(unit) + 1):
        options = [best[s] + p.score[unit[s:e]] for s in range(e) if unit[s:e] in p.score]
        if unit[e - 1] not in p.score:
            options.append(best[e - 1] + p.unknown)
        best.append(max(options))
    return best[-1]


def test_sentencepiece(spark):
    p = pieces.Pieces(open(pieces.default_model(), "rb").read())
    texts = ["the quick theorem", "", None, " lead", "two  spaces ", "line\nend", "日本 🙂 é", "a" * 5000, "▁mark", "the the the"]
    df = docs(spark, list(enumerate(texts)))
    out = pieces.decode(pieces.encode(df)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert r.sp_text == (t or "").replace(pieces.MARK, " ")
        norm = p.normalise(t or "")
        score = sum(p.score[p.pieces[i]] if p.pieces[i] in p.score else 0 for i in r.sp_ids)
        if all(c in p.score for c in norm) and norm:
            assert score == best_score(p, norm)
    assert out[1].sp_ids == [] and out[2].sp_ids == []


@given(st.text(alphabet="abthe é▁\n日", max_size=40))
@settings(max_examples=150, deadline=None)
def test_sentencepiece_round_trip(text):
    p = test_sentencepiece_round_trip.__dict__.setdefault("p", pieces.Pieces(open(pieces.default_model(), "rb").read()))
    ids = np.frombuffer(pieces.Encoder(p).encode([text])[0], "<i4").astype(np.int64)
    assert p.decode(ids, np.array([len(ids)])) == [text.replace(pieces.MARK, " ")]


# 4 decontamination
def shingles(t, k=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_decontamination(spark):
    items = [(i, prose(i, n)) for i, n in enumerate([6, 9, 30, 59, 200])] + [(5, "two words"), (6, ""), (7, None), (8, prose(2, 30))]
    rows = [(i, prose(100 + i, 60) + " " + (items[i % 5][1] if i % 2 else " ".join(items[i % 5][1].split()[:3])) + "\n" + prose(200 + i, 3000 if i == 7 else 40)) for i in range(30)]
    rows += [(50, " ".join(prose(2, 30).split()[:28]).upper()), (51, None), (52, ""), (53, "two words"), (53, "two words"), (None, prose(0, 6)), (54, " ".join(x for _, x in items if x))]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc, r.item, r.n_item, r.n_shared) for r in contamination.contained_items(docs(spark, rows), it).collect())
    want = []
    for d, t in rows:
        for i, x in items:
            s = shingles(x)
            n = len(s & shingles(t))
            if d is not None and s and 10 * n >= 8 * len(s):
                want.append((d, i, len(s), n))
    assert got == sorted(want) and len(want) > 15
    kept = contamination.without_items(docs(spark, rows), it)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {w[0] for w in want})
    assert contamination.contained_items(docs(spark, rows), it.limit(0)).count() == 0


def test_minhash_finds_what_a_lookup_finds():
    """Items of 20 to 400 shingles with four fifths of their shingles or a little less in texts; MinHash must find nearly all pairs of the larger ones."""
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in r.integers(20, 400, 300)]
    items = contamination.Items(list(range(len(sets))), sets)
    wanted = found = by_minima = large = 0
    for i, s in enumerate(sets):
        for share in (0.75, 0.8, 0.81, 0.9, 1.0):
            n = int(np.ceil(share * len(s) - 1e-9))
            text = np.unique(np.concatenate((r.permutation(s)[:n], r.integers(0, 1 << 63, 500).astype(np.uint64), sets[(i + 1) % 300][:3])))
            want = {j for j, x in enumerate(sets) if len(np.intersect1d(x, text)) >= 0.8 * len(x) - 1e-9}
            got = items.found(text)
            assert {j for j, *_ in got} <= want
            wanted, found = wanted + len(want), found + len(got)
            by_minima += sum(m for *_, m in got)
            large += sum(len(sets[j]) >= 64 for j in want)
    assert found >= 0.999 * wanted and by_minima >= 0.9 * large and wanted > 1000


def test_containment_in_parts(spark, monkeypatch):
    it = spark.createDataFrame([(i, prose(i, 30)) for i in range(8)], "item_id long, text string")
    rows = [(i, prose(i, 30) + " " + prose(90 + i, 50)) for i in range(8)]
    monkeypatch.setattr(contamination, "ITEM_SHINGLES", 100)
    assert contamination._parts(it, "item_id", "text") > 1
    assert contamination.contained_items(docs(spark, rows), it).count() == 8


# 5 token files
@given(st.lists(st.lists(st.integers(0, 65535) | st.sampled_from([1, 2, 3]), max_size=300), max_size=6))
@settings(max_examples=25, deadline=None)
def test_coder_round_trip(blocks):
    blocks = [np.array(b, dtype=np.int64) for b in blocks]
    found = idcoder.decode(idcoder.encode(blocks), [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, found, strict=True))


def test_coder_compresses_and_checks():
    block = np.tile(np.arange(50), 80)
    value = idcoder.pack_blocks([(block, 0, np.array([9]), np.array([len(block)]))])[0]
    assert len(value) < len(block) // 2
    ids, first, ids_of, sizes = idcoder.unpack_blocks([value])[0]
    assert np.array_equal(ids, block) and first == 0 and ids_of.tolist() == [9] and sizes.tolist() == [len(block)]
    for broken in (b"XXXX" + value[4:], value[:-1], value[: len(value) // 2] + bytes([value[len(value) // 2] ^ 1]) + value[len(value) // 2 + 1 :]):
        with pytest.raises(ValueError):
            idcoder.unpack_blocks([broken])


def test_token_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello  WORLD, it's 42\n\u00a0été", "", None, "a" * 300, "x <|endoftext|> y", prose(3, 9000), "hello", "hello"]
    rows = [(30 - i, t) for i, t in enumerate(texts)] + [(24, "tie"), (24, "tie")]
    files = tokenfiles.write(docs(spark, rows))
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.documents_of(files).orderBy("start").collect()]
    tk = tokenizers.Tokenizer.from_file(tokenfiles.default_tokenizer())
    coded = [(i, tk.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    assert [g[0] for g in got] == sorted(i for i, _ in rows)
    starts, at = [], 0
    for g in got:
        starts.append(at)
        at += g[2]
    assert [g[1] for g in got] == starts
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    assert tokenfiles.documents_of(tokenfiles.write(docs(spark, rows).limit(0))).count() == 0


def test_tokens_at_every_space_and_control_character():
    """Each character that Python or Unicode counts as space, separator or control, between, before and after words."""
    tokenizers = pytest.importorskip("tokenizers")
    import unicodedata

    spec = open(tokenfiles.default_tokenizer()).read()
    tk, state = tokenizers.Tokenizer.from_str(spec), tokenfiles.Tokens(spec, 2)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc", "Cf"))]
    texts = [f"abc{c}def {c}{c}x e{c}\u0301" for c in chars] + ["", " ", "w" * 70 + " " + "w" * 70 + "v", "x <|startoftext|>y", "don't  STOP", "e\u0301 \u0301e"]
    for t, ids in zip(texts, state.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids + [2], repr(t)


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5))
def test_checksums_join(parts):
    value, whole = zlib.crc32(parts[0]), parts[0]
    for p in parts[1:]:
        value, whole = tokenfiles.joined_crc(value, zlib.crc32(p), len(p)), whole + p
    assert value == zlib.crc32(whole)


def test_token_files_in_many_pieces(spark, monkeypatch):
    """Blocks of few ids, dealt to several tasks, so that documents end in other tasks."""
    monkeypatch.setattr(idcoder, "BLOCK_IDS", 50)
    rows = [(i, prose(i, 30 + 40 * (i % 5))) for i in range(40)]
    files = tokenfiles.write(docs(spark, rows))
    whole = sorted((r.id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.documents_of(files).collect())
    dealt = tokenfiles.documents_of(files.repartition(7, "seq").sortWithinPartitions("part", "seq"))
    assert sorted((r.id, r.start, r.n_tokens, r.ids_crc32) for r in dealt.collect()) == whole
    back = tokenfiles.read(files).groupBy("id").agg(F.sum(F.length("ids")).alias("n")).collect()
    assert {r.id: r.n // 4 for r in back} == {i: n for i, _, n, _ in whole}


def test_blocks_learn_from_all_their_ids():
    """Blocks of 2,048 ids, each with a blank model of its own, left order 1 little to learn from: 14.8 bits an id here."""
    r = np.random.default_rng(5)
    after, ids = r.permutation(20_000), np.zeros(1 << 18, np.int64)
    jump, there = r.random(len(ids)) < 0.1, r.integers(0, 20_000, len(ids))
    for i in range(1, len(ids)):
        ids[i] = there[i] if jump[i] else after[ids[i - 1]]
    blocks = list(tokenfiles._blocks(iter([(7, ids)])))
    values = idcoder.pack_blocks(blocks)
    assert sum(map(len, values)) * 8 < 6 * len(ids)
    assert np.array_equal(np.concatenate([b[0] for b in idcoder.unpack_blocks(values)]), ids)


def test_words_are_encoded_many_at_a_time(monkeypatch):
    """One text a word cost the library more than its merges; ids stay those of the library, with the mark in words, long words and a table that is cleared."""
    tokenizers = pytest.importorskip("tokenizers")
    spec = open(tokenfiles.default_tokenizer()).read()
    tk, state, asked = tokenizers.Tokenizer.from_str(spec), tokenfiles.Tokens(spec, 2), []
    whole = state.whole
    monkeypatch.setattr(state, "whole", lambda texts: asked.append(len(texts)) or whole(texts))
    texts = [" ".join(f"Word{i * 7919 % 5003}x{j}," for i in range(500)) for j in range(12)] + ["^ ^^ a^b x^2 ^", "^", "w" * 65 + "^ " + "w" * 65, "e\u0301 \u212a \u0301^ ^\u0301", "it's 0 o'clock 'S"]
    for _ in range(2):
        for t, ids in zip(texts, state.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids + [2], t
    assert sum(asked) < 100 and state.words > 6000
    monkeypatch.setattr(tokenfiles, "CACHE", 10)
    assert state.encode([b"again  again"])[0].tolist() == tk.encode("again again", add_special_tokens=False).ids + [2] and state.words == 1


def test_variants_of_a_word_are_encoded_once():
    """Case and punctuation made each variant a word of its own for the library; ids stay those of the library where cutting or lower-casing first would change them."""
    tokenizers = pytest.importorskip("tokenizers")
    spec = open(tokenfiles.default_tokenizer()).read()
    tk, state = tokenizers.Tokenizer.from_str(spec), tokenfiles.Tokens(spec, 2)
    texts = [f"{x}Stra\u00dfe{y} {x}\u00c9T\u00c9{y} {x.lower()}\u00e9t\u00e9{y}" for x in ("", "(", '"', "--") for y in ("", ",", ".", ")...", "!?", "/STRA\u00dfe")]
    for t, ids in zip(texts, state.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids + [2], t
    assert state.words <= 2 + 9
    parts = ["H\u0331", "h\u0331", "E\u0301", "\u00dc\u0304", "\u00d7", "\u00f7", "\u00aa", "\u0130", "\u00ff", "\u00de", "\u00c0", "=", "\u0338", "'S", "'ll", "'", "T", "s", "7", "\u00b2", "^", "<|", "ENDOFTEXT", "|>", "_", "\u0000", "\u001c", "\u007f", "\u00a0", "\u4e2d", "\U0001f600", " "]
    r = np.random.default_rng(7)
    texts = ["".join(r.choice(parts, int(n))) for n in r.integers(1, 12, 4000)]
    for t, ids in zip(texts, state.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_other_tokenizers_get_whole_words():
    """Where texts are cut in another way, case and punctuation stay with the word."""
    tokenizers = pytest.importorskip("tokenizers")
    spec = json.loads(open(tokenfiles.default_tokenizer()).read())
    spec["normalizer"]["normalizers"].pop()
    tk, state = tokenizers.Tokenizer.from_str(json.dumps(spec)), tokenfiles.Tokens(json.dumps(spec), 2)
    text = "the The THE the, The, (THE)"
    assert state.encode([text.encode()])[0].tolist() == tk.encode(text, add_special_tokens=False).ids + [2] and state.words == 6


def test_a_step_puts_out_one_word_a_lane_at_most(monkeypatch):
    """Lanes went through rounds of 16 bits in each step; rare and frequent ids over many lanes come back."""
    r, asked = np.random.default_rng(3), []
    put = idcoder._Encoder.put
    monkeypatch.setattr(idcoder._Encoder, "put", lambda self, go: asked.append(len(go)) or put(self, go))
    for likely in (0.0, 0.5, 0.999, 1.0):
        ids = np.where(r.random(1 << 17) < likely, 7, r.integers(0, 65536, 1 << 17))
        asked.clear()
        code = idcoder.encode([ids])
        assert np.array_equal(idcoder.decode(code, [len(ids)])[0], ids)
        assert len(asked) <= idcoder.RUN_IDS + 1 and max(asked) <= len(ids) // idcoder.RUN_IDS


# 6 toxicity
def test_toxicity(spark):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(f"w{x}" for x in r.integers(0, 80, 8)) + "." for _ in range(6)]
        toxic = i % 5 == 0
        if toxic:
            sentences[3] = "W1 w2, You VILE" + ("ness" if i % 2 else "") + " w3!"
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    df = docs(spark, rows + [(900, None), (901, ""), (902, "!!!"), (0, rows[0][1])])
    lab = spark.createDataFrame(labels + [(900, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab, where=F.col("doc_id") % 3 != 0)
    out = toxicity.score(df, model).collect()
    held = [x for x in out if x.doc_id % 3 == 0 and x.doc_id < 900]
    assert np.mean([(x.tox_score >= 0.5) == (x.doc_id % 5 == 0) for x in held]) > 0.97
    for x in out:
        if x.doc_id < 900 and x.tox_score >= 0.5 and x.doc_id % 5 == 0:
            assert any("VILE" in x.text.encode()[s.start : s.end].decode() for s in x.tox_sentences)
    assert {x.tox_score for x in out if x.doc_id >= 900} == {0.0}
    assert toxicity.score(df, toxicity.fit(df, lab.limit(0))).where("tox_score >= 0.5").count() == 0


def test_toxicity_scores_match_a_loop(spark):
    """Noisy-or over sentences cut by a pattern, with each word's weight looked up alone; very long, empty and repeated texts."""
    r = np.random.default_rng(3)
    model = (r.normal(size=toxicity.DIMENSIONS) * 0.8, -2.0)
    texts = [prose(1, 40).replace("w1", "W1!"), "One. Two?\nthree\r four, five", prose(2, 30_000).replace(" w7", ". w7"), "", None, "...", "É çà. A-b_c", "x", "x"]
    out = toxicity.score(docs(spark, list(enumerate(texts))).withColumn("tox_score", F.lit("mine")), model).orderBy("doc_id").collect()

    def logit(word):
        return sum(float(np.float32(model[0][s[0]])) for s in toxicity.Bags([word.encode()]).slots)

    known = {}
    for got, text in zip(out, texts, strict=True):
        clean, bad = 1.0, 0
        for sentence in re.split(r"[.!?\n\r]", text or ""):
            words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", sentence)
            if words:
                p = 1 / (1 + np.exp(-np.clip(sum(known.setdefault(w, logit(w)) for w in words) + model[1], -30, 30)))
                clean, bad = clean * (1 - p), bad + (p >= 0.5)
        assert got.tox_score == pytest.approx(1 - clean, abs=1e-5) and abs(len(got.tox_sentences) - bad) <= 1


def test_toxicity_is_trained_on_a_part_at_a_time(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice(("stuff", "fine.", "awful", "day!")) + str(r.randrange(300)) for _ in range(r.randrange(300))).encode() for _ in range(3000)]
    y = np.array([b"awful7" in t for t in texts], dtype=np.int64)
    found = []
    for size in (1 << 16, 1 << 30):
        monkeypatch.setattr(toxicity, "PART_BYTES", size)
        monkeypatch.setattr(toxicity, "PART_SENTENCES", size // 64)
        tracemalloc.start()
        found.append((*toxicity.train(texts, y, rounds=3), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    (weights, bias, peak), (whole, at_once, most) = found
    assert np.array_equal(weights, whole) and bias == at_once
    assert peak < most / 3
    assert not toxicity.train([b"", b"."], np.array([0, 1]), rounds=1)[0].any()


def test_toxicity_sample_counts_copies_once(spark, monkeypatch):
    """Texts 0 to 11, each with 20 ids and one label; text 0 has both labels, and one row stands twice."""
    monkeypatch.setattr(toxicity, "train", lambda texts, y: list(zip(texts, y.tolist(), strict=True)))
    df = docs(spark, [(i, prose(i % 12, 20)) for i in range(240)] + [(1, prose(1, 20))])
    lab = spark.createDataFrame([(i, int(i == 12 or i % 3 == 1)) for i in range(240)], "doc_id long, toxic int")
    want = {(prose(t, 20).encode(), int(t % 3 == 1)) for t in range(12)} | {(prose(0, 20).encode(), 1)}
    rows = toxicity.fit(df, lab)
    assert len(rows) == 13 and set(rows) == want
    monkeypatch.setattr(toxicity, "FIT_ROWS", 10)
    assert len(set(toxicity.fit(df, lab))) == 10


# 7 Jaccard join
def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if (a and b and 100 * len(a & b) >= 80 * len(a | b)) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return sorted((i, len(s), least[i]) for i, s in sets)


def edited(text, seed, n):
    r, w = np.random.default_rng(seed), text.split()
    for _ in range(n):
        w[r.integers(len(w))] = f"z{r.integers(10**6)}"
    return " ".join(w)


def test_jaccard_join(spark):
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(i, edited(base, i, i % 5)) for i in range(120)] + [(200 + i, passage + " " + prose(300 + i, 80)) for i in range(40)]
    rows += [(400 + i, prose(7, 30) if i % 2 else edited(prose(7, 30), i, 1)) for i in range(12)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A b"), (504, "b a"), (505, "  "), (506, base.upper().replace(" ", "\n")), (507, base), (507, base), (None, base), (508, prose(9, 6000))]
    got = sorted((r.id, r.n_shingles, r.component) for r in jaccard.similar_components(docs(spark, rows)).collect())
    assert got == brute_components(rows)
    kept = jaccard.without_copies(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in got} | {None}
    assert jaccard.similar_components(docs(spark, rows).limit(0)).count() == 0


def test_jaccard_join_with_one_id_on_different_texts(spark):
    """Id 7 stands on texts A and B, with a near copy of each; id 8 on a near copy of C and on a text of its own."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(7, a), (7, b), (1, edited(a, 1, 1)), (2, edited(b, 2, 1)), (3, c), (8, edited(c, 3, 1)), (8, prose(4, 80)), (9, None)]
    got = {(r.id, r.component) for r in jaccard.similar_components(docs(spark, rows)).collect()}
    assert got == {(1, 1), (7, 1), (2, 2), (7, 2), (3, 3), (8, 3), (8, 8), (9, 9)}
    kept = jaccard.without_copies(docs(spark, rows))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in (rows[2], rows[3], rows[4], rows[6], rows[7]))


def test_jaccard_join_with_crowds(spark, monkeypatch):
    """Small limits, so that pivots, large regions, cells and blocks all take part."""
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 3000)
    across = []
    monkeypatch.setattr(jaccard, "_across_parts", lambda *a, f=jaccard._across_parts: across.append(f(*a)) or across[-1])
    a, b = prose(1, 150), prose(2, 90)
    rows = [(i, edited(a, i, int(i % 9))) for i in range(260)] + [(1000 + i, edited(b, i, int(i % 6))) for i in range(200)] + [(2000 + i, prose(50 + i, 100)) for i in range(30)]
    got = sorted((r.id, r.n_shingles, r.component) for r in jaccard.similar_components(docs(spark, rows, False)).collect())
    assert got == brute_components(rows)
    assert across and across[0].count() > 100


def test_jaccard_meetings_do_not_grow_with_the_square(spark):
    """A family of f near copies makes a row for each document and key, and one for each bucket."""
    for f in (50, 200):
        values = [packing.pack(np.arange(20, dtype=np.uint64), np.array([i]), np.array([100], np.int32), np.array([20], np.int32), np.ones(20, np.int32)) for i in range(f)]
        assert sum(b.num_rows for b in jaccard._meetings(values, 4)) == f - 1 + 4


@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12))
@settings(max_examples=80, deadline=None)
def test_joined_sets_are_a_spanning_forest(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    pairs, pivot = jaccard.joined(arrays)
    assert 0 <= pivot < len(sets)
    root = {i: i for i in range(len(sets))}
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if jaccard.linked(len(a & b), len(a), len(b)) and a & b:
                    root[i] = root[j] = min(root[i], root[j])
    got = {i: i for i in range(len(sets))}
    for _ in sets:
        for x, y in pairs:
            assert jaccard.linked(len(sets[x] & sets[y]), len(sets[x]), len(sets[y]))
            got[x] = got[y] = min(got[x], got[y])
    assert got == root and len(pairs) == len(sets) - len(set(root.values()))


@given(st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1))
def test_prefixes_of_linked_sets_meet(a, b):
    if jaccard.linked(len(a & b), len(a), len(b)):
        assert set(sorted(a)[: jaccard.prefix_size(len(a))]) & set(sorted(b)[: jaccard.prefix_size(len(b))])


def test_short_sets_differ_by_length():
    one, two = shingle_sets(Words([b"a", b"a b c d e"]))
    assert len(one) == len(two) == 1 and one[0] != two[0]


# 8 URL filter
def test_url_filter(spark):
    urls = ["https://A.example.ORG/es/1?x", "http://example.org/en/12", "http://sub.example.org/en/12", "http://my.com/fr/a", "http://my.com/de/", "http://com/de", "http://org", "http://x.net#a?b", "nothing", None, "", "http://cheap-pills.shop.net/buy", "http://quiet-garden.net/en/5", "http://xorg/", "ftp://u@h.org:80/p?q#r", "http://a.org/x://b.com/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("said", F.lit("x"))
    out = urlfilter.judge(df).orderBy("page_id").collect()
    for r, u in zip(out, urls, strict=True):
        assert (r.url_host, r.url_path) == urlfilter.split_url(u)
    assert [r.url_rule for r in out[:7]] == ["example.org/es/", "example.org/en/1", "example.org/en/1", "com/fr/", "com/de/", None, None]
    assert out[13].url_rule is None and out[14].url_rule is None and out[15].url_rule == "org/"
    assert out[11].url_verdict == "block" and out[12].url_verdict == "allow" and out[0].url_verdict == "block" and out[3].url_verdict == "allow"
    assert {r.url_verdict for r in out} == {"allow", "block"} and urlfilter.judge(df.limit(0)).count() == 0


def url_accuracy(rows, w):
    hosts, paths = zip(*[urlfilter.split_url(u) for u, _ in rows], strict=True)
    row, slot = urlfilter.features(hosts, paths)
    z = np.bincount(row, weights=w[slot], minlength=len(rows)) / np.sqrt(np.bincount(row, minlength=len(rows))) + w[-1]
    return np.mean((z > 0) == np.array([y == 1 for _, y in rows]))


def test_url_model_on_labels_that_it_has_not_seen():
    """Four folds of the labelled table."""
    rows = urlfilter.labelled_urls()
    held = [url_accuracy([r for i, r in enumerate(rows) if i // 2 % 4 == f], urlfilter.train([r for i, r in enumerate(rows) if i // 2 % 4 != f])) for f in range(4)]
    assert len(rows) >= 90 and np.mean(held) > 0.7 and url_accuracy(rows, urlfilter.train(rows)) > 0.97


def test_url_scores_match_a_dictionary(spark):
    """The logistic score from n-grams kept in Python sets."""
    w = urlfilter.train(urlfilter.labelled_urls())
    urls = ["https://free-bets.test/win?x", "http://Library.test/", "ftp://é.test/ü", "x://", "none", None, "http://" + "a" * 3000, "http://aa.test/b", "http://aa.test/b"]

    def slot(field, gram):
        h = 0
        for c in gram:
            h = (h * 0xD6E8FEB86659FD93 + c + 1) % 2**64
        return int(urlfilter.mix(np.array([(h + 1000 * field + len(gram)) % 2**64], dtype=np.uint64))[0] % np.uint64(urlfilter.DIMENSIONS))

    out = urlfilter.judge(spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, url_score string")).orderBy("page_id").collect()
    for r, u in zip(out, urls, strict=True):
        grams = set()
        for field, text in enumerate(urlfilter.split_url(u)):
            raw = b"^" + text.encode() + b"$"
            grams |= {slot(field, raw[i : i + n]) + urlfilter.DIMENSIONS * 0 for n in urlfilter.SIZES for i in range(len(raw) - n + 1)}
        z = sum(w[g] for g in grams) / max(1, len(grams)) ** 0.5 + w[-1]
        assert r.url_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


# 9 exact top-k
def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) if abs(x) < 1e300 else int(np.sign(x) * np.finfo(float).max) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scores = sorted([(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, c, strict=True)))), i) for i, c in good if i != q and len(c) == len(v)])[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("query_rows", [2, 1000])
def test_exact_top_k(spark, monkeypatch, query_rows):
    """Small blocks, so that several blocks of cells and of queries take part; nulls, ties, repeated rows, other lengths and huge components."""
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vafile, "QUERY_ROWS", query_rows)
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(200)] + [(300 + i, [0.5] * 8) for i in range(20)] + [(301, [0.5] * 8)]
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [1.0, 2.0]), (710, [3.0, -1.0]), (750, []), (None, [0.1] * 8), (50, rows[50][1])]
    rows += [(800, [1e30] * 3), (801, [-1e30] * 3), (802, [1e300, 1e300, -1e300]), (803, [1.0, 1.0, 1.0]), (850, [float(1 << 40)] * 3), (851, [float(1 << 20), -7.0, 3.5]), (852, [1e308] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"part": F.lit(1), "h": F.lit(2), "upper": F.lit("x")})
    got = sorted(tuple(x) for x in vafile.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_vectors_are_read_by_bound(spark, monkeypatch):
    """Few of the candidates survive the scan of the cells, and fewer are read exactly."""
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=32)]) for i in range(4000)]
    read, score = [], vafile.written
    monkeypatch.setattr(vafile, "written", lambda df: read.append(score(df)) or read[-1])
    out = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert out.count() == 80 * 5
    survivors = [f for f in read if "upper" in f.columns]
    assert survivors[0].count() < 0.2 * 80 * 4000


# 10 substring dedup
def brute_windows(rows, k=13):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - k + 1 if i is not None else 0):
            g = tuple(w[a : a + k])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1 if i is not None else 0):
            if least[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("common", [False, True])
def test_substring_dedup(spark, monkeypatch, common):
    """Without a floor for common buckets nearly all are common, so the digest path does the work."""
    if common:
        monkeypatch.setattr(superkmers, "WORKER_WINDOWS", 1)
        monkeypatch.setattr(superkmers, "COMMON_KEYS", 0)
    passage = prose(1, 55)
    rows = [(i, prose(100 + i, 30) + "\n" + passage + " " + prose(200 + i, 30)) for i in range(60)] + [(100 + i, prose(7, 90)) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "short one"), (203, "same same " * 40), (204, "same same " * 40), (205, prose(7, 13)), (206, prose(7, 12)), (103, "other " + prose(7, 60)), (None, passage), (207, prose(5, 5000)), (208, "A" + prose(7, 30))]
    got = sorted([(r.doc_id, r.sk_words, r.sk_removed, r.sk_kept) for r in superkmers.with_repeats_removed(docs(spark, rows)).collect()], key=str)
    assert got == brute_windows(rows)
    assert superkmers.with_repeats_removed(docs(spark, rows).limit(0)).count() == 0


def test_texts_are_cut_by_the_block():
    r = random.Random(8)
    texts = [b"", b" ", " \té  ünd b\r\n".encode(), b"x"] + [b" \n".join(r.choice((b"aa", b"b", "ö".encode())) for _ in range(r.randrange(20))) for _ in range(200)]
    spans = [None if r.random() < 0.3 else [{"sk_start": a, "sk_end": r.randint(a + 1, n)} for a in (r.randrange(n) for _ in range(r.randrange(4)))] if (n := len(t.split())) else [] for t in texts]
    kept, have, gone = superkmers._cut(texts, pa.array(spans, pa.list_(pa.struct([("sk_start", pa.int32()), ("sk_end", pa.int32())]))))
    want = [[w for i, w in enumerate(t.split()) if not any(x["sk_start"] <= i < x["sk_end"] for x in s or ())] for t, s in zip(texts, spans, strict=True)]
    assert [x.encode() for x in kept.to_pylist()] == [b" ".join(w) for w in want]
    assert have.tolist() == [len(t.split()) for t in texts]
    assert gone.tolist() == [len(t.split()) - len(w) for t, w in zip(texts, want, strict=True)]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    texts = [b"one two " * 40, b"y" * 300 + b" one", b"", b"two"]
    whole = Words(texts).hashes(), window_hashes(Words(texts).hashes(), 5)
    monkeypatch.setattr(textblocks, "SLICE", 16)
    monkeypatch.setattr(textblocks, "_slice_powers", textblocks._slice_powers.__wrapped__)
    h = Words(texts).hashes()
    assert np.array_equal(h, whole[0]) and np.array_equal(window_hashes(h, 5), whole[1])


def test_windows_travel_as_super_kmers_with_many_partitions():
    """With 10,000 partitions and eight windows of text for each key, hardly any bucket is common."""
    keys = packing.KEYS_PER_PARTITION * 10_000
    least = np.random.default_rng(1).integers(0, 1 << 62, 2_000_000).astype(np.uint64)
    sizes = np.bincount((superkmers.mix(least) % np.uint64(superkmers.bucket_count(keys))).astype(np.int64), minlength=superkmers.bucket_count(keys))
    assert superkmers.bucket_count(keys) >= 50 * keys
    assert sizes[sizes > superkmers.COMMON_KEYS * sizes.sum() // keys].sum() < 0.01 * sizes.sum()


def test_equal_hashes_are_told_apart():
    raw = b"a b c a b d a b c"
    begin, finish = np.array([0, 6, 12]), np.array([5, 11, 17])
    assert superkmers._repeats(raw, begin, finish, np.zeros(3, np.uint64), np.array([1, 2, 3])).tolist() == [False, False, True]


def test_window_hash_depends_on_order():
    h = np.array([1, 2, 3, 2, 1], dtype=np.uint64)
    g = window_hashes(h, 3)
    assert len(set(g.tolist())) == 3 and hashlib.sha256(g.tobytes()).digest()


# one message, one row of unusual size
def test_quotation_linking_of_a_message_of_100000_lines(spark):
    """Alternating levels make as many passages as lines; time must not grow with their square."""
    text = "\n".join(f"> log line {i}" if i % 2 else f"answer {i}" for i in range(100_000))
    rows = [(1, 0, "user", "\n".join(f"log line {i}" for i in range(1, 100, 2))), (1, 1, "user", text)]
    began = time.time()
    out = {r.turn: r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].q_parent == 0 and out[1].q_passages == 50 and time.time() - began < 60


def test_top_k_with_outliers_keeps_few_survivors(spark):
    """Rows of a thousand times the others' size must not widen the cells of the rest."""
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (3000, 32)) * np.where(np.arange(3000) % 700 == 3, 1000, 1)[:, None]
    v[::5] = np.round(v[::5], 1)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in vafile.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()}
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 3000, 50):
        s = w @ w[q]
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in best]
    x = vafile.scaled(v[np.arange(3000) % 700 != 3])[:2048]
    cells, low, high = vafile.cut(x)
    lower, upper = vafile.bounds(vafile.scaled(v[:60]), cells, low, high)
    limit = np.sort(lower, axis=1)[:, -5]
    assert (upper >= limit[:, None]).mean() < 0.05
    exact = vafile.scaled(v[:60]) @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_round_trip_runs_one_python_pass(spark):
    """Three chained Python workers a task (encode, decode, checksum) hung on check_l once."""
    import zlib

    import numpy as np

    from batchloom.llm import pieces

    df = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, ""), (4, "ação ☃ x")], "doc_id long, text string")
    out = pieces.round_trip(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    want = {r.doc_id: (list(r.sp_ids), r.sp_text) for r in pieces.decode(pieces.encode(df)).collect()}
    got = out.collect()
    assert {r.doc_id: (list(r.sp_ids), r.sp_text) for r in got} == want
    assert all(r.sp_crc == zlib.crc32(np.array(r.sp_ids, dtype="<u4").tobytes()) for r in got)
