"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.llm import chat, contamination, language, line_dedup, negatives, personal_data, pieces, quality, simhash, spelling, toxicity, url_filters, warc
from quillgrid.llm.oracle import LLM_ORACLE as LLM_ORACLE
from quillgrid.session import spread_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op7_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    told = chat.read_conversations(chat.format_windows(turns.union(extra)))
    return told.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_pii(spark, sf_dir):
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [personal_data.count_kind("base", kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(personal_data.span_text("base"), 256).alias("base_sha256"), personal_data.span_text("spans").alias("spans"),
    )


def op9_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op1_warc(spark, sf_dir):
    chunks = warc.archive_round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return chunks.where("is_last").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("chunk_no") + 1).alias("n_chunks"), (F.col("payload_digest") == F.col("declared_digest")).alias("digest_matches"),
    )


def op2_url_filters(spark, sf_dir):
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)


def op4_sentencepiece(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(documents, "text", ("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id", F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op5_benchmark_decontamination(spark, sf_dir):
    documents, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.decontaminate(documents, bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_simhash_near_dedup(spark, sf_dir):
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark, sf_dir):
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.coalesce(language.remainder("doc_id") == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, label=label)


def op12_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(documents, labels)
    held_out = F.coalesce(language.remainder("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_warc, op2_url_filters, op3_line_dedup, op4_sentencepiece, op5_benchmark_decontamination, op6_simhash_near_dedup, op7_chat_formatting,
    op8_pii, op9_quality_rules, op10_language_id, op11_hard_negatives, op12_toxicity, op13_spelling_variants,
)}
