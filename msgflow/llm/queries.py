"""The operators of this package applied to the given tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from msgflow.llm import (language_crf, line_chunks, multi_index, ngram_join, page_difference as page_difference_, personal_data, pieces, prefix_trie,
                         projection_forest, shards, warc, weighted_prints, winnow)
from msgflow.staging import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------- n-gram join

SQL_NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""


@query("op1_metric_regions", SQL_NGRAM_JOIN)
def metric_regions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = ngram_join.components(docs, "doc_id", "text", ngram_join.Rule(3, 90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


# ------------------------------------------------------------------ sharding


def sql_crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes by the usual table of 256 entries, made from its polynomial."""
    entries = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        entries.append(n)
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ({entries}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


def sql_shards(shard_count: int) -> str:
    now = shards.map_for(shard_count)
    return f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {shards.VIRTUAL_SLOTS} AS virtual
  FROM documents),
placed AS (SELECT *, ({now}::INT[])[virtual + 1] AS shard, ({shards.grown_map(now)}::INT[])[virtual + 1] AS grown_shard FROM sized)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""


@query("op4_virtual_slots", sql_shards(16))
def virtual_slots(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 16)


# ---------------------------------------------------------------- line dedup

SQL_LINE_CHUNKS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM l),
f AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS upto, lead(p) OVER o AS after FROM w WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT a.doc_id, a.k AS ka, z.k AS kz, a.p AS pa, coalesce(z.after - 1, 1000000000) AS pz
  FROM f a JOIN f z ON a.doc_id = z.doc_id AND z.k BETWEEN a.k AND a.k + {line_chunks.LEAST_WORDS}
    AND z.upto - a.upto + a.w >= {line_chunks.LEAST_WORDS}
    AND (z.upto - z.w - a.upto + a.w < {line_chunks.LEAST_WORDS} OR z.upto - a.upto < {line_chunks.LEAST_WORDS})),
t AS (SELECT s.doc_id, pa, pz, string_agg(f.t, chr(10) ORDER BY f.k) AS t FROM s JOIN f ON f.doc_id = s.doc_id AND f.k BETWEEN ka AND kz GROUP BY ALL),
m AS (SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(pz) OVER o AS first_end FROM t WINDOW o AS (PARTITION BY t ORDER BY doc_id, pa, pz)),
g AS (SELECT DISTINCT l.doc_id, l.p FROM m JOIN l ON l.doc_id = m.doc_id AND l.p BETWEEN pa AND pz WHERE m.doc_id <> first_doc OR pa > first_end),
r AS (SELECT l.doc_id, count(g.p) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '') AS t
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY 1)
SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(r.t, ''))::BIGINT AS n_chars, sha256(coalesce(r.t, '')) AS text_sha256
FROM documents LEFT JOIN r USING (doc_id)"""


@query("op5_line_chunks", SQL_LINE_CHUNKS)
def repeated_lines(spark, sf_dir):
    """What is left of each document: the number of its lost lines, and length and SHA-256 of the text."""
    left = line_chunks.deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_removed", F.length(text).cast("long").alias("n_chars"),
                       F.sha2(text.cast("binary"), 256).alias("text_sha256"))


# ----------------------------------------------------------- decontamination

SQL_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM met) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM met) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op8_winnowing", SQL_CONTAMINATION)
def winnowing(spark, sf_dir):
    judged = winnow.contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  table(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


# ---------------------------------------------------------------------- WARC


SQL_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  translate(array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(h), g * 5 + 1, 5))::BIGINT // s % 32)::BIGINT + 1, 1)), '')), ''), '', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""


@query("op3_warc_index_first", SQL_ARCHIVES)
def warc_index_first(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    records = warc.read_records(warc.index_archives(spark, path)).drop("payload")
    full = warc.with_payloads(records, ["payload_bytes"])
    return full.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --------------------------------------------------------------- language ID


def language_model(spark, sf_dir):
    """The CRF learned from text and language of the documents that are not held out."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~language_crf.held_out(F.col("doc_id")))
    return language_crf.train(language_crf.training_segments(rows, "text", "lang"))


@query("op6_conditional_field")
def conditional_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("held_out", language_crf.held_out(F.col("doc_id")))
    found = language_crf.predicted(docs, "text", language_model(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score")


# ------------------------------------------------------------- SentencePiece


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_piece_rounds")
def piece_rounds(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents", "doc_id", "text"), "text", piece_model())


# -------------------------------------------------------------- fingerprints


@query("op9_weighted_sampling")
def weighted_sampling(spark, sf_dir):
    return weighted_prints.edit_probe(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


# ------------------------------------------------------------- personal data


@query("op10_candidate_boosting")
def candidate_boosting(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = personal_data.find(docs, "text", *personal_data.fit(docs, "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: x == F.lit(k)), False)).cast("long").alias(f"n_{k}")  # noqa: B023
              for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.written("base").cast("binary"), 256).alias("base_sha256"),
                        personal_data.written("spans").alias("spans"))


# ---------------------------------------------------------------- page texts


@query("op2_page_difference")
def page_difference(spark, sf_dir):
    return page_difference_.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


# ------------------------------------------------------- conversation prefixes


SQL_PREFIXES = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS l, {sql_crc32("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
kk AS (SELECT k.c, k.h, k.c - k.c % 5 AS b, least(k.h, coalesce(o.l, 0)) AS taken FROM k LEFT JOIN k o ON o.c = k.c - k.c % 5),
p AS (SELECT kk.c, i AS d, r, x FROM kk JOIN t ON t.c = kk.b AND t.i <= kk.h
  UNION ALL SELECT kk.c, taken + i - h, r, x FROM kk JOIN t ON t.c = kk.c AND t.i > kk.h),
q AS (SELECT c, 0 AS d, 0 AS bytes, '' AS key FROM kk UNION ALL SELECT c, d, octet_length(encode(x)),
  string_agg(md5(length(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) FROM p),
q2 AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above, max(d) OVER (PARTITION BY c) AS len FROM q),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, any_value(above) AS above,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '')) AS ends_sha256 FROM q2 GROUP BY d, key),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
under AS (SELECT DISTINCT a.d, a.key, z.d AS low, z.key AS below FROM q a JOIN q z ON a.c = z.c AND z.d >= a.d),
sums AS (SELECT u.d, u.key, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM under u JOIN n ON n.d = u.low AND n.key = u.below LEFT JOIN kids k ON k.d = u.low AND k.key = u.below GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.d = n.d AND sums.key = n.key LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key
LEFT JOIN n o ON o.d = n.d - 1 AND o.key = n.above"""


@query("op11_prefix_trie", SQL_PREFIXES)
def conversation_prefixes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(turns, group=5, heads=9))


# ------------------------------------------------------------------- vectors


@query("op12_projection_forest")
def projection_forest_(spark, sf_dir):
    """The 20 nearest found of every twentieth id; approximate, so compared with brute force in the tests."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return projection_forest.nearest(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


SQL_HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INT AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5"""


@query("op13_multi_index", SQL_HARD_NEGATIVES)
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows.withColumn("label", label), "vec_id", "label", "embedding", F.col("vec_id") % 100 == 0)


# ------------------------------------------------------------------ pipeline


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
