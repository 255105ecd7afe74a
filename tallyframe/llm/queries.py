"""The operators as queries over the given tables, with DuckDB SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import centroids, chat, decontaminate, language, neardup, neighbours, packing, sharding, substrings, toxicity, urlfilter, warc, whitening
from tallyframe.llm.shared import stored, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = F.inline(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(n).alias("turn"), F.lit(role).alias("role"), said) for n, role in enumerate(("user", "assistant"))]))
    return chat.conversation_digests(chat.chat_windows(turns.unionByName(spark.range(0, 1, 1, 1).select(extra))))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(rule, ("host", "path", "verdict"))]) for rule in RULES]))
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), spark.range(0, 1, 1, 1).select(rules))


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page: the first is a full response, of the others most are revisits. Validators now and
    then change or are missing."""
    c = pages.select("page_id", "url", F.md5("html").alias("body"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    kind = F.when((F.col("k") == 0) | ((F.col("page_id") + F.col("k")) % 5 == 0), "response").otherwise("revisit")
    etag = F.when((F.col("page_id") + F.col("k")) % 7 != 0, F.concat(F.lit('"'), F.substring("body", 1, 8), F.when((F.col("page_id") % 11 == 0) & (F.col("k") == 3), "x").otherwise(""), F.lit('"')))
    stamp = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    return c.select(
        (F.col("page_id") * 4 + F.col("k")).alias("record_id"), "url",
        F.timestamp_seconds(1_600_000_000 + F.col("page_id") % 1000 * 60 + F.col("k") * 40_000).alias("at"), kind.alias("kind"), etag.alias("etag"),
        F.when(F.col("page_id") % 3 != 0, stamp).alias("last_modified"), F.when(F.col("page_id") % 2 == 0, F.col("body")).alias("digest"),
        F.create_map(F.lit("date"), F.concat(F.lit("t"), F.col("k").cast("string")), F.lit("content-type"), F.concat(F.lit("html"), F.col("k").cast("string"))).alias("headers"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    head = lambda k: F.col("headers")[k]
    return r.select("record_id", "canonical", F.unix_timestamp("at").alias("at_s"), "status", "response_id", head("date").alias("date"), head("content-type").alias("content_type"), "digest")


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(_crc_mod(3) != 1))
    out = docs.select("doc_id", F.coalesce(_crc_mod(3) == 1, F.lit(False)).alias("held_out"), language.detect_language(model, F.col("text")).alias("x"))
    return out.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(_crc_mod(5) != 0))
    out = docs.select("doc_id", F.coalesce(_crc_mod(5) == 0, F.lit(False)).alias("held_out"), toxicity.score_toxicity(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10)
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in found]) if len(found) else F.array(F.lit(""))
    return centroids.with_inertia(stored(clustered)).withColumn("centroid_sha256", F.get(names, F.col("cluster")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


def queries() -> dict:
    return {"op1_decontaminate": op1_decontaminate, "op2_revisits": op2_revisits, "op3_chat_windows": op3_chat_windows, "op4_near_duplicates": op4_near_duplicates, "op5_language": op5_language, "op6_nearest": op6_nearest, "op7_url_filter": op7_url_filter, "op8_shards": op8_shards, "op9_toxicity": op9_toxicity, "op10_packing": op10_packing, "op11_repeats": op11_repeats, "op12_centroids": op12_centroids, "op13_whitening": op13_whitening}


def oracle_sql() -> dict[str, str]:
    from tallyframe.llm import oracles

    return oracles.SQL
