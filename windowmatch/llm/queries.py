"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowmatch.llm import (
    chat, decontaminate, html_crf, lang_crf, merkle, packing, pq_dedup, resample, sanitise, secret_scan, simhash, sql,
    suffix_tree, token_frames,
)
from windowmatch.llm.shared import fold, table, vocabulary


def op1_decontamination(spark, sf_dir):
    """Documents that contain a benchmark item, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_tree(spark, sf_dir):
    """Log probability of every document, by a tree that has not seen a fifth of them."""
    docs = table(spark, sf_dir, "documents")
    seen = docs.where(fold(F.col("doc_id")) != 1)
    tree, counts = suffix_tree.train(seen.select(F.col("text").cast("binary").alias("text")))
    found = suffix_tree.score(docs, tree, counts.frame)
    held_out = (fold(F.col("doc_id")) == 1).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_packing(spark, sf_dir):
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_secrets(spark, sf_dir):
    """Every secret found in the documents, with its place."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability")


def op5_html(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.train(pages), "html", "page_id", "url")


def language_model(docs):
    """Fitted on documents outside the fold that is held out."""
    return lang_crf.train(docs.where(fold(F.col("doc_id")) != 0))


def op6_language(spark, sf_dir):
    """Language of every document, by a model that has not seen a fifth of them."""
    docs = table(spark, sf_dir, "documents")
    found = lang_crf.identify(docs, language_model(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op7_sanitise(spark, sf_dir):
    """Personal data of every document, with the terms that give it away."""
    found = sanitise.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(sanitise.digest(sanitise.base_only(F.col("spans"))), 256).alias("base_sha256"),
        sanitise.digest(F.col("spans")).alias("spans"),
        "n_term",
    )


def op8_simhash(spark, sf_dir):
    """Fingerprint and class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_frames(spark, sf_dir):
    """Every document as read back from the written files."""
    return token_frames.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), spark)


def op10_embeddings(spark, sf_dir):
    """Links and class of every embedding."""
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_resampling(spark, sf_dir):
    """Weight, score and rank of every document, drawn towards the texts of the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark, sf_dir):
    """Proof of every document, checked after a third of them were tampered with."""
    return merkle.verify_tampering(table(spark, sf_dir, "documents"))


def op13_chat(spark, sf_dir):
    """Every conversation, and one of control strings alone, as read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations")
    control = spark.range(2).select(
        F.lit(sql.CONTROL_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sql.CONTROL_TEXT).alias("text"),
    )
    found = chat.format_threads(rows.select(*control.columns).union(control))
    back = chat.read_back(F.col("formatted"), F.col("mask")).alias("back")
    return found.select(F.col("tree").alias("conv_id"), back).select("conv_id", "back.*")


def queries():
    return {
        "op1_decontamination": op1_decontamination,
        "op2_suffix_tree": op2_suffix_tree,
        "op3_packing": op3_packing,
        "op4_secrets": op4_secrets,
        "op5_html": op5_html,
        "op6_language": op6_language,
        "op7_sanitise": op7_sanitise,
        "op8_simhash": op8_simhash,
        "op9_token_frames": op9_token_frames,
        "op10_embeddings": op10_embeddings,
        "op11_resampling": op11_resampling,
        "op12_merkle": op12_merkle,
        "op13_chat": op13_chat,
    }


def oracle_sql():
    """The other queries need XXH64, tokenizers or trained models, or are too slow in SQL on whole tables."""
    return {"op11_resampling": sql.RESAMPLE, "op12_merkle": sql.MERKLE, "op13_chat": sql.CHAT}
