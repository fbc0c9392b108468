"""The operators' registered queries (production parameters, whole tables) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import fingerprint, langid, media, neardup, packing, pieces, rollup, secrets, sharding, toxicity
from fieldloom.llm.store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined("spans", base_only=True).cast("binary"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(_fold(3) != 1))
    out = langid.predict(docs, profiles)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str, counters: dict[str, rollup.Counter] | None = None) -> DataFrame:
    """Inserts all documents, revises them to their text without its first line, deletes later copies, repeats the first batch."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    roll = rollup.Rollup(spark, Scratch(spark, "rollup").root, counters)
    first = docs.withColumn("op", F.lit("insert"))
    roll.apply("1-load", first)
    roll.apply("2-headless", docs.withColumns({"op": F.lit("revise"), "text": F.regexp_replace("text", r"^[^\n]*\n", "")}))
    sums = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).where("sha is not null")
    copies = sums.join(sums.groupBy("sha").agg(F.min("doc_id").alias("least")), "sha").where("doc_id <> least")
    none = F.lit(None).cast("string")
    roll.apply("3-copies", copies.select(F.lit("delete").alias("op"), "doc_id", none.alias("source"), none.alias("lang"), none.alias("text")))
    roll.apply("1-load", first)
    return roll.totals()


def op3_tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes, counted by the supplied tokenizer too, which is beyond SQL."""
    return op3_token_counts(spark, sf_dir, rollup.NATIVE | {"word_bpe_49k@1": rollup.bpe(vocabulary())})


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by Viterbi: how many pieces it has, and the digests of their ids and of the text that these decode to."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index, base = media.store(_table(spark, sf_dir, "documents"))
    back = media.read_back(index, base)
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    return rows.join(back, "digest").select(*cols)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.assign(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), train=_fold(4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.with_edits(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("edits").cast("long").alias("n_edits"))


SHARD_BYTES = 1 << 20

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op3_tokenizer_counts": op3_tokenizer_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_media_columns": op5_media_columns,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_sharding": op7_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_document_fingerprints": op10_document_fingerprints,
}

ORACLES = {
    "op3_token_counts": r"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least FROM documents),
k AS (SELECT source, lang, regexp_replace(coalesce(text, ''), '^[^\n]*\n', '') AS t FROM d WHERE text IS NULL OR doc_id = least),
v AS (SELECT source, lang, 'words@1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM k
    UNION ALL SELECT source, lang, 'pieces@1', len(regexp_extract_all(t, '[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]')) FROM k)
SELECT source, lang, version, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM v GROUP BY ALL
""",
    "op7_sharding": rf"""
WITH RECURSIVE r AS (SELECT doc_id, ('0x' || substring(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
s(doc_id, h, bytes, depth, total, alone) AS (
    SELECT doc_id, h, bytes, 0, sum(bytes) OVER (), min(h) OVER () = max(h) OVER () FROM r
    UNION ALL
    SELECT doc_id, h, bytes, depth + 1, sum(bytes) OVER w, min(h) OVER w = max(h) OVER w FROM s WHERE total > {SHARD_BYTES} AND NOT alone AND depth < 60
    WINDOW w AS (PARTITION BY h >> (60 - depth - 1)))
SELECT doc_id, bytes, depth::INT AS depth, CASE WHEN depth = 0 THEN '-' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard, total > {SHARD_BYTES} AS oversize
FROM s WHERE total <= {SHARD_BYTES} OR alone OR depth = 60
""",
    "op10_document_fingerprints": fingerprint.ORACLE,
}
