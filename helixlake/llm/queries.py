"""The ten queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, labelled, packing, quality, sharding, simhash, substring_dedup, topk, toxicity

PER_CLASS = 3000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chat(turns.unionByName(extra))
    made = made.withColumns({"turns": chat.read_chat(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _classified(scored: DataFrame, id_col: str, held_out) -> DataFrame:
    return scored.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    rest = labelled.remainder("doc_id", 3)
    weights = quality.fit(labelled.sample(docs, labels, "quality", rest != 1, PER_CLASS))
    return _classified(quality.score(docs, weights, with_text=False), "doc_id", rest == 1)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    rest = labelled.remainder("doc_id", 5)
    model = toxicity.fit(labelled.known(docs, labels, "toxic", rest != 0))
    return _classified(toxicity.score(docs, model, with_text=False), "doc_id", rest == 0)


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_chat_format": chat_format,
    "op2_substring_dedup": substring,
    "op3_hash_prefix_forest": nearest,
    "op4_quality_classifier": quality_scores,
    "op5_toxicity": toxicity_scores,
    "op6_exact_top_products": top_products,
    "op7_pack": pack,
    "op8_bpe": encode,
    "op9_shard": shard,
    "op10_simhash": near_copies,
}

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
placed AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w = role, false) AS more, coalesce(lead(role) OVER w = role, false) AS open
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + CASE WHEN more THEN 11 ELSE 13 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n')) END
    + CASE WHEN open THEN 0 ELSE 11 END AS chars FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op2_substring_dedup": r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT r, i, sha256(array_to_string(list_slice(words, i, i + 34), ' ')) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM split WHERE len(words) >= 35)),
again AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS i FROM again, range(0, 35) AS o(j)),
lists AS (SELECT r, list(i) AS positions FROM gone GROUP BY r),
joined AS (
  SELECT doc_id, words, coalesce(positions, []) AS positions,
    list_filter(words, lambda x, i: NOT list_contains(coalesce(positions, []), i)) AS kept
  FROM split LEFT JOIN lists USING (r))
SELECT doc_id, len(words)::BIGINT AS n_words, len(positions)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM joined""",
    "op6_exact_top_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
