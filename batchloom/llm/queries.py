"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import chatrepair, chattrie, contamination, jaccard, langid, licences, pieces, quotes, superkmers, tokenfiles, toxicity, urlfilter, vafile
from batchloom.llm.durable import written
from batchloom.llm.textblocks import documents


def held_out(doc_id: str = "doc_id"):
    """Rows kept away from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the turn it replies to, its thread and depth, and its own text without quotes."""
    out = quotes.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    digest = F.sha2("q_body", 256).alias("body_sha256")
    return out.select("conv_id", "turn", "role", F.col("q_level").alias("max_level"), F.col("q_passages").alias("n_linked"), F.col("q_parent").alias("parent_turn"), F.col("q_root").alias("root_turn"), F.col("q_depth").alias("depth"), digest)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out()).select("text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_rejected").alias("rejected"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by count and checksum, and whether decoding gives the text back."""
    out = pieces.round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    same = F.col("sp_text") == F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return out.select("doc_id", F.size("sp_ids").cast("long").alias("n_tokens"), F.col("sp_crc").alias("ids_crc32"), same.alias("round_trip"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item it contains."""
    found = contamination.contained_items(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the written files."""
    files = tokenfiles.write(documents(spark, sf_dir).select("doc_id", "text"))
    return tokenfiles.documents_of(files).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text by a model of the labelled documents outside the held-out fifth."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out())
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_sentences").alias("n_sentences"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a similarity of at least 0.8 of their 5-word shingle sets."""
    out = jaccard.similar_components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    out = urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each vector whose id is divisible by 50."""
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text less those in 13-word windows that also start in a document with a smaller id."""
    out = superkmers.with_repeats_removed(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("sk_words").alias("n_words"), F.col("sk_removed").alias("n_removed"), F.sha2("sk_kept", 256).alias("kept_sha256"))


def damaged(messages: DataFrame) -> DataFrame:
    """Conversations with planted faults; nulls become one space (a null turn or conversation only in the drawing of the fault)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(x), F.lit(" ")) for x in ("role", "text"))
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fault")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cost, edits and digest of its cheapest repair."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = written(chatrepair.repair(damaged(messages)))
    found = chatrepair.report(repaired).join(chatrepair.digests(repaired).withColumnRenamed("c", "d"), F.col("c") == F.col("d"), "left").drop("c", "d")
    found = found.withColumnRenamed("conv_id", "found")
    out = messages.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations, each rebuilt on the first turns of the first one of its twenty."""
    c = F.col("c")
    borrowed = F.crc32(c.cast("string").cast("binary")) % 4
    rows = written(chattrie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    nodes = chattrie.trie(*chattrie.with_bases(rows, c - c % 20, borrowed, 3))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every text."""
    out = licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    ends = [F.array_min(F.transform("lic_base", lambda b: b["i"])), F.array_max(F.transform("lic_base", lambda b: b["i"]))]
    return out.select(
        "doc_id", F.col("lic_words").alias("n_words"), F.size("lic_base").cast("long").alias("n_base"), ends[0].cast("long").alias("first_word"), ends[1].cast("long").alias("last_word"),
        F.array_join("lic_base_labels", ",").alias("base_labels"), F.array_join("lic_labels", ",").alias("labels"), F.col("lic_score").alias("score"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


ORACLES = {
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13
), l AS (
  SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT s.doc_id, s.i FROM s JOIN l USING (g) WHERE s.doc_id > l.least
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM hit, unnest(range(0, 13)) AS u(o)
), lost AS (
  SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_decontamination": r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), g AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id
), s AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM g d JOIN g i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id
)
SELECT doc_id, item_id, CAST(n.n AS INTEGER) AS n_item, CAST(s.n AS INTEGER) AS n_shared FROM s JOIN n ON n.id = s.item_id WHERE 10 * s.n >= 8 * n.n""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), s AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT x, y FROM s JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id""",
    "op1_quotation_linking": r"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT row_number() OVER () AS k, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations
), l AS MATERIALIZED (
  SELECT k, conv_id, turn, i, len(ls) AS n, regexp_extract(ls[i], '^(?:[ \t]{0,3}>)+[ \t]?') AS lead, ls[i] AS line FROM m, unnest(range(1, len(ls) + 1)) AS u(i)
), p AS MATERIALIZED (
  SELECT k, conv_id, turn, i, len(regexp_replace(lead, '[^>]', '', 'g')) AS level, substr(line, len(lead) + 1) AS rest FROM l
), g AS (
  SELECT *, sum(d) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY k ORDER BY i) THEN 1 ELSE 0 END AS d FROM p)
), a AS (
  SELECT k, conv_id, turn, any_value(level) AS level, string_agg(rest, chr(10) ORDER BY i) AS t FROM g GROUP BY k, conv_id, turn, run
  UNION ALL SELECT k, conv_id, turn, level, rest FROM p
), s AS MATERIALIZED (
  SELECT DISTINCT k, conv_id, turn, level, trim(lower(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g'))) AS t FROM a
), q AS (
  SELECT x.k, x.conv_id, x.turn, x.level, len(x.t) AS n, min(o.turn) AS source FROM s x JOIN s o ON o.conv_id = x.conv_id AND o.t = x.t AND o.level = 0
  WHERE x.level > 0 AND x.t <> '' GROUP BY x.k, x.conv_id, x.turn, x.level, x.t HAVING min(o.turn) < x.turn
), c AS (
  SELECT k, conv_id, turn, source, sum(CASE WHEN level = 1 THEN n ELSE 0 END) AS n, count(*) AS links FROM q GROUP BY ALL
), f AS MATERIALIZED (
  SELECT k, conv_id, turn, CAST(sum(links) AS BIGINT) AS n_linked, arg_max(source, (n, source)) FILTER (n > 0) AS parent FROM c GROUP BY ALL
), h AS (
  SELECT conv_id, turn, min(parent) AS up FROM f WHERE parent IS NOT NULL GROUP BY ALL
), r AS (
  SELECT conv_id, turn, up, 1 AS depth FROM h UNION ALL SELECT r.conv_id, r.turn, h.up, r.depth + 1 FROM r JOIN h ON h.conv_id = r.conv_id AND h.turn = r.up
), e AS (
  SELECT conv_id, turn, min(up) AS root, max(depth) AS depth FROM r GROUP BY ALL
), b AS (
  SELECT k, max(level) AS max_level, coalesce(string_agg(rest, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(after > 0, false) AND regexp_matches(rest, '(?i)^(on\b.{1,200}\bwrote|.{1,200}\b(a écrit|schrieb|escribió))[ \t]*:[ \t]*$'))), '') AS body
  FROM (SELECT *, lead(level) OVER (PARTITION BY k ORDER BY i) AS after FROM p) GROUP BY k
)
SELECT m.conv_id, m.turn, m.role, CAST(max_level AS INTEGER) AS max_level, coalesce(n_linked, 0) AS n_linked, parent AS parent_turn, coalesce(root, m.turn) AS root_turn, coalesce(depth, 0) AS depth,
  sha256(trim(body, chr(32) || chr(9) || chr(10) || chr(13))) AS body_sha256
FROM m JOIN b USING (k) LEFT JOIN f USING (k) LEFT JOIN e ON e.conv_id = m.conv_id AND e.turn = m.turn""",
}

def crc32_sql(text: str) -> str:
    """DuckDB has no CRC-32: the unsigned checksum of an ASCII text, bit by bit."""
    step = "lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)"
    each = f"lambda a, b: list_reduce(range(0, 8), {step}, xor(a, b))"
    return f"xor(list_reduce(list_transform(range(0, len({text})), lambda i: CAST(ascii(({text})[i + 1]) AS BIGINT)), {each}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _repair_sql() -> str:
    """Backwards over a conversation's rows; four values (cost, labels, repaired lines), one for each grammar state, compared in that order."""
    to = {"u": (3, 3, None, 3), "a": (None, None, 4, None), "s": (2, None, None, None)}  # next state (from 1) for each initial
    forced = ("u", "u", "a", "u")
    names = {"u": "user", "a": "assistant"}

    def value(cost: str, label: str, line: str, after: str) -> str:
        return f"{{'c': {cost} + {after}.c, 's': '{label}' || {after}.s, 't': {line} || {after}.t}}"

    def inserted(bare: str, later: str) -> str:
        """One insertion more before each state's best."""
        each = [f"list_min([{bare}[{g + 1}], {value('3', 'I', chr(39) + names[forced[g]] + ':' + chr(39) + ' || chr(10)', f'{later}[{to[forced[g]][g]}]')}])" for g in range(4)]
        return f"[{', '.join(each)}]"

    def read(g: int) -> str:
        w = "acc.v"
        r = forced[g]
        free, more = "r.f NOT IN (1, 2)", "CASE WHEN r.f = 3 THEN 3 ELSE 0 END"
        found = [value("4", "D", "''", f"{w}[{g + 1}]")]
        found += [f"CASE WHEN {free} AND left(r.role, 1) = '{i}' THEN {value(more, 'K', 'r.role || chr(58) || r.text || chr(10)', f'{w}[{t[g]}]')} END" for i, t in to.items() if t[g]]
        found.append(f"CASE WHEN {free} THEN {value('3 + ' + more, 'R', chr(39) + names[r] + ':' + chr(39) + ' || r.text || chr(10)', f'{w}[{to[r][g]}]')} END")
        return f"list_min([{', '.join(found)}])"

    ends = ", ".join("{'c': %s, 's': '', 't': ''}" % c for c in ("CAST(0 AS BIGINT)", "CAST(1000000000 AS BIGINT)", "CAST(1000000000 AS BIGINT)", "CAST(0 AS BIGINT)"))
    last = "list_transform(list_transform([v0], lambda b: [b, %s]), lambda p: %s)[1]" % (inserted("b", "b"), inserted("p[1]", "p[2]"))
    step = "list_transform(list_transform([[%s]], lambda b: [b, %s]), lambda p: %s)[1]" % (", ".join(read(g) for g in range(4)), inserted("b", "b"), inserted("p[1]", "p[2]"))
    crc = crc32_sql("k")
    return rf"""
WITH k AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), x AS MATERIALIZED (
  SELECT *, {crc} % 20 AS f FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM x, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE f <> 0
), o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS whole FROM d
), f AS MATERIALIZED (
  SELECT *, CASE WHEN whole = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(whole, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o
), n AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'f': f, 'role': role, 'text': text}} ORDER BY i DESC) AS rows
  FROM f GROUP BY conv_id
), e AS (
  SELECT *, list_reduce(list_transform(rows, lambda y: {{'r': y, 'v': z}}), lambda acc, w: list_transform([w.r], lambda r: {{'r': r, 'v': {step}}})[1], {{'r': rows[1], 'v': z}}).v[1] AS best
  FROM (SELECT n.*, {last} AS z FROM n, (SELECT [{ends}] AS v0))
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(left(best.t, greatest(len(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES["op11_conversation_repair"] = _repair_sql()
ORACLES["op12_conversation_trie"] = rf"""
WITH o AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS x, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), s AS MATERIALIZED (
  SELECT c, own, c - c % 20 AS b, h FROM (SELECT c, count(*) AS own FROM o GROUP BY c) a JOIN (SELECT CAST(k AS BIGINT) AS c, {crc32_sql('k')} % 4 AS h FROM (SELECT DISTINCT CAST(c AS VARCHAR) AS k FROM o)) USING (c)
), p AS MATERIALIZED (
  SELECT s.c, s.b, s.h, least(s.h, coalesce(t.own, 0)) AS got FROM s LEFT JOIN s t ON t.c = s.b
), r AS (
  SELECT o.c, i - h + got AS i, x, words FROM o JOIN p ON p.c = o.c WHERE i > h UNION ALL SELECT p.c, i, x, words FROM o JOIN p ON p.b = o.c WHERE i <= got
), l AS MATERIALIZED (
  SELECT p.c, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), []) AS xs, coalesce(list(words ORDER BY i) FILTER (x IS NOT NULL), []) AS ws FROM p LEFT JOIN r USING (c) GROUP BY p.c
), m AS MATERIALIZED (
  SELECT c, d, array_to_string(xs[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(xs) AS ended, xs FROM l, unnest(range(0, len(xs) + 1)) AS u(d)
), n AS MATERIALIZED (
  SELECT k, d, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256, any_value(xs[1:d]) AS xs FROM m GROUP BY k, d
), q AS MATERIALIZED (
  SELECT n.k, n.d, n.conv_id, n.n_convs, n.saved, n.ends_sha256, n.xs, t.conv_id AS parent_conv_id, (SELECT count(*) FROM n b WHERE b.up = n.k AND b.d = n.d + 1) AS n_children FROM n LEFT JOIN n t ON t.k = n.up AND t.d = n.d - 1
), z AS (
  SELECT array_to_string(xs[1:e], ',') AS k, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM q, unnest(range(0, d + 1)) AS u(e) GROUP BY ALL
)
SELECT conv_id, CAST(q.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM q JOIN z ON z.k = q.k AND z.d = q.d"""


def _licence_sql() -> str:
    """The templates' words and key phrases as rows; frequencies, anchors, alignments and phrases by joins on positions."""
    quoted = lambda x: "'" + x + "'"
    known = licences.templates()
    words = ", ".join(f"({t}, {i}, {quoted(w)})" for t, x in enumerate(known) for i, w in enumerate(x.words))
    keys = ", ".join(f"({t}, {n}, {at + k}, {quoted(w)})" for t, x in enumerate(known) for n, (p, at) in enumerate(x.phrases) for k, w in enumerate(p.split(" ")))
    names = ", ".join(f"({t}, {quoted(x.label)}, {sum(len(p.split(' ')) for p, _ in x.phrases)})" for t, x in enumerate(known))
    base = ", ".join(f"({n}, {k}, {quoted(w)}, {quoted(label)}, {len(p.split(' '))})" for n, (p, label) in enumerate(licences.BASE.items()) for k, w in enumerate(p.split(" ")))
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), w AS MATERIALIZED (
  SELECT k, i - 1 AS i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(i)
), b AS (
  SELECT k, i - q AS i, label FROM w JOIN (VALUES {base}) AS p(n, q, w, label, parts) USING (w) GROUP BY k, i - q, n, label, parts HAVING count(*) = parts
), bases AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY k
), t AS (
  SELECT t, min(q) AS q, w FROM (VALUES {words}) AS p(t, q, w) GROUP BY t, w
), f AS (
  SELECT w, count(DISTINCT k) AS df FROM w WHERE w IN (SELECT w FROM t) GROUP BY w
), a AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY weight DESC, w) AS r FROM (
    SELECT t, q, t.w, greatest(1, CAST(round_even(1000 * ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)), 0) AS BIGINT)) AS weight FROM t LEFT JOIN f ON f.w = t.w)) WHERE r <= {licences.ANCHORS}
), h AS (
  SELECT k, t, i - q AS start, sum(weight) AS held FROM w JOIN a USING (w) GROUP BY ALL
), v AS (
  SELECT k, t, i - q AS start, count(*) AS parts FROM w JOIN (VALUES {keys}) AS p(t, n, q, w) USING (w) GROUP BY ALL
), m AS (
  SELECT k, label, held / total AS share FROM h JOIN v USING (k, t, start) JOIN (VALUES {names}) AS x(t, label, needed) USING (t) JOIN (SELECT t, sum(weight) AS total FROM a GROUP BY t) USING (t) WHERE v.parts = needed AND held >= {licences.SHARE} * total
), e AS (
  SELECT k, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY k
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(bases.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(e.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(CAST(share AS DOUBLE), 0.0) END AS score
FROM d LEFT JOIN bases USING (k) LEFT JOIN e USING (k)"""


ORACLES["op13_license_scan"] = _licence_sql()
