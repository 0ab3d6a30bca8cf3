"""The registered queries of the llm operators, and their SQL counterparts."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.llm import (
    byte_bpe, chat_collapse, circulant_minhash, context_tree, contextual_pii, flat_graph, kneser_ney, longest_match,
    merkle_manifest, neighbour_votes, prefix_join, suffix_html, word_counts, zone_blocks,
)
from labelsieve.plans.registry import Query
from labelsieve.session import materialize

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def register(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = byte_bpe.read_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = materialize(byte_bpe.encode(docs, "text", definition).drop("text"))
    decoded = byte_bpe.decode(encoded, "ids", definition)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def crc_mod(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def toxicity_model(spark: SparkSession, sf_dir: str) -> kneser_ney.ToxicityModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod("doc_id", 3) != 1)
    return kneser_ney.fit(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "toxic")


@register("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = kneser_ney.score(docs, "text", toxicity_model(spark, sf_dir)).drop("text")
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@register("op9_decontamination", sql=r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 13) AS length FROM b WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, length, array_to_string(words[s:s + length - 1], ' ') AS passage
  FROM (SELECT item_id, words, length, unnest(range(1, len(words) - length + 2)) AS s FROM sized)),
lengths AS (SELECT DISTINCT length FROM windows),
grams AS (
  SELECT doc_id, s, length, array_to_string(words[s:s + length - 1], ' ') AS passage
  FROM (SELECT doc_id, words, length, unnest(range(1, len(words) - length + 2)) AS s FROM d, lengths WHERE len(words) >= length)),
hits AS (SELECT doc_id, s, length, item_id FROM grams JOIN windows USING (length, passage)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + length)) AS p FROM (SELECT DISTINCT doc_id, s, length FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = prefix_join.mark_contamination(
        docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", ("doc_id", "text"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@register("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contextual_pii.with_spans(docs, "text", ("doc_id", "text")).drop("text")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in contextual_pii.KINDS],
        F.sha2(contextual_pii.span_text(F.col("base")), 256).alias("base_sha256"),
        contextual_pii.span_text(F.col("spans")).alias("spans"))


@register("op2_minhash", sql=r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
mutual AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM mutual UNION SELECT reach.doc_id, mutual.b FROM reach JOIN mutual ON mutual.a = reach.r),
lowest AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id)::BIGINT AS component_id,
  coalesce(r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN lowest USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return circulant_minhash.near_duplicates(docs, "text", "doc_id").select("doc_id", "n_shingles", "component_id", "kept")


@register("op7_chat_collapse", sql="""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, pos, max(pos) OVER (PARTITION BY conv_id) AS n,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM t),
whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY prefix, n),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = whole.prefix AND p.pos = whole.n AND p.pos < p.n)),
texts AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, length(rendered)::BIGINT AS n_chars, sha256(rendered) AS rendered_sha256
FROM kept JOIN texts USING (conv_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chat_collapse.collapse(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return kept.select(
        F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies",
        F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


@register("op4_longest_match")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = byte_bpe.vocabulary(byte_bpe.read_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json")).to_pylist()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return longest_match.count_pieces(docs, "text", pieces).select("doc_id", "n_words", "n_pieces")


@register("op8_flat_graph", sql="""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT a AS vec_id, b AS r FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
lowest AS (SELECT vec_id, min(r) AS r FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(coalesce(r, vec_id), vec_id)::BIGINT AS component_id,
  least(coalesce(r, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN lowest USING (vec_id) LEFT JOIN degree USING (vec_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@register("op1_context_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    training = docs.filter(~held_out).select("text")
    counts, model = word_counts.count_words(training, "text"), context_tree.fit(training, "text")
    known = context_tree.known_scores(docs.withColumn("held_out", held_out), "text", model)
    known = word_counts.known_words(known, "text", counts).drop("text")
    rows = materialize(known.withColumn("_row", F.monotonically_increasing_id()))
    return word_counts.add_rare(context_tree.add_missed(rows, model), counts).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score",
        F.col("log10_probability").alias("score"), "n_bytes", "bits_per_byte")


@register("op5_suffix_html")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = suffix_html.main_text(pages, "url", "html")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@register("op12_merkle_manifest", sql="""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
      coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
      coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, leaf, CASE WHEN crc % 2 = 0 THEN changed ELSE leaf END AS checked, source,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS r,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
inner_nodes AS (
  SELECT r AS tree, 0 AS level, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY r) AS size FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 2) // 3
  FROM inner_nodes WHERE size > 1 GROUP BY tree, idx // 3),
subroots AS (SELECT tree AS idx, h FROM inner_nodes WHERE size = 1),
top_nodes AS (
  SELECT 0 AS level, idx, h, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 2) // 3
  FROM top_nodes WHERE size > 1 GROUP BY idx // 3),
heights AS (SELECT tree, max(level) AS height FROM inner_nodes GROUP BY tree),
nodes AS (
  SELECT tree, level, idx, h FROM inner_nodes WHERE size > 1
  UNION ALL SELECT -1, level, idx, h FROM top_nodes WHERE size > 1),
ways AS (
  SELECT r, pos, level AS step, tree, level, pos // (3 ** level)::BIGINT AS idx
  FROM leaves JOIN (SELECT DISTINCT tree, level FROM nodes WHERE tree >= 0) ON tree = r
  UNION ALL
  SELECT r, pos, height + level, -1, level, r // (3 ** level)::BIGINT
  FROM leaves JOIN heights ON tree = r, (SELECT DISTINCT level FROM nodes WHERE tree = -1)),
steps AS (
  SELECT r, pos, step, coalesce(string_agg(h, '' ORDER BY n.idx) FILTER (n.idx < w.idx), '') AS lhs,
    coalesce(string_agg(h, '' ORDER BY n.idx) FILTER (n.idx > w.idx), '') AS rhs
  FROM ways w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.idx // 3 = w.idx // 3 GROUP BY r, pos, step),
proofs AS (SELECT r, pos, string_agg(lhs || rhs, '' ORDER BY step) AS proof FROM steps GROUP BY r, pos),
folds AS (
  SELECT r, pos, 0::BIGINT AS step, checked AS h FROM leaves
  UNION ALL
  SELECT r, pos, step + 1, sha256(lhs || h || rhs) FROM folds JOIN steps USING (r, pos, step)),
folded AS (SELECT r, pos, arg_max(h, step) AS folded_root FROM folds GROUP BY r, pos)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM leaves JOIN subroots s ON s.idx = r JOIN folded USING (r, pos) LEFT JOIN proofs USING (r, pos), (SELECT h FROM top_nodes WHERE size = 1) t
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = [F.col(c) for c in LEAF_COLUMNS]
    stripped = [*leaf[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    changed = F.when(crc_mod("doc_id", 2) == 0, merkle_manifest.leaf_digest(stripped))
    proofs = merkle_manifest.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "source", merkle_manifest.leaf_digest(leaf), changed)
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@register("op11_zone_blocks", sql="""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull() & fine).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    found = zone_blocks.hard_negatives(rows, "vec_id", "label", "q", F.col("vec_id") % 100 == 0)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        "positive_score", "negative_score")


@register("op13_neighbour_votes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(crc_mod("doc_id", 3) != 1)
    model = neighbour_votes.fit(docs, labels, "doc_id", "text", "quality")
    return neighbour_votes.score(docs, "text", model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
