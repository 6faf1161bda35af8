"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import byte_bpe, compaction, cross_entropy, exact_dedup, language_id, mixing, packing, resampling, simhash, suffix_dedup, url_rules, vector_tree, warc
from folio.storage import new_path, saved


#: Ids of target documents up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_TARGETS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def bpe_model() -> tuple[bytes, str]:
    import public_tokenizers

    return byte_bpe.serialise_model(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame) -> DataFrame:
    model, pattern = bpe_model()
    rows = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), model, pattern, by_stretch=True).drop("text"), model, pattern, by_stretch=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op4_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = vector_tree.build(vectors, k=5)
    return vector_tree.search(index, vectors.where("vec_id % 50 = 0"), k=5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    read = warc.with_digests(warc.read_archive(spark, path))
    rows = saved(read.select("id", "warc_type", "refers_to", "payload_digest", "payload_bytes", "own_digest"), "warc-pages")
    responses = rows.where("warc_type = 'response'")
    sizes = responses.groupBy(F.col("id").alias("refers_to"), F.col("own_digest").alias("payload_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("warc_type = 'revisit'").select("id", "refers_to", "payload_digest").join(sizes, ["refers_to", "payload_digest"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = responses.select(F.col("id"), "payload_bytes", "own_digest", "warc_type", F.lit(None).cast("long")).toDF(*out)
    return first.union(revisits.select("id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to").toDF(*out))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    mined = url_rules.mine(pages.join(labels, "page_id"))
    return url_rules.judge(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    found = language_id.judge(docs, ~out, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_copies", "copy_no", "mix_key", "n_chars", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic; background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id", F.lit(True).alias("target")).distinct()
    good = saved(good, "target-ids")
    good = F.broadcast(good) if good.count() <= BROADCAST_TARGETS else good
    found = cross_entropy.fit_and_score(docs.join(good, "doc_id", "left"))
    return found.select("doc_id", "n_tokens", *(F.round(c, 9).alias(c) for c in ("target_loss", "background_loss", "score")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens; an empty or null text is its end id alone."""
    import public_tokenizers

    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the texts of benchmark."""
    docs = table(spark, sf_dir, "documents")
    gain = resampling.gains(resampling.count(docs), resampling.count(table(spark, sf_dir, "benchmark")))
    found = resampling.draw(resampling.weigh(docs, gain), percent=25)
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks in files by day, lot and piece, small ones joined; a new folder at each call, which stays."""
    folder = new_path(spark, "clicks")
    files, rows = compaction.write_files(table(spark, sf_dir, "clicks"), folder, "arrived_at", "click_id")
    found = compaction.digests(compaction.compact(files, rows, folder), "click_id", "value")
    return found.select("day", "lot", "piece", "n_rows", F.col("min_id").alias("min_click_id"), F.col("max_id").alias("max_click_id"), "cents", "sources", "ids_sha256", "columns", "path", "rewritten")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_exact_dedup, op3_byte_bpe, op4_vector_tree, op5_warc, op6_suffix_dedup, op7_url_rules, op8_language_id, op9_mixing,
        op10_cross_entropy, op11_packing, op12_resampling, op13_compaction,
    )
}
