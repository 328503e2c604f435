"""The corpus operators over the supplied tables, one query each, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table
from caseloom.llm.decontamination import contaminated
from caseloom.llm.languages import fit_languages, language_mixtures
from caseloom.llm.mixing import mixed_rows
from caseloom.llm.near_dups import near_duplicates
from caseloom.llm.pii import pseudonymise
from caseloom.llm.prefix_trie import prefix_trie, rebuilt, turn_rows, with_ends
from caseloom.llm.quality_classifier import fit_compression_model, score_quality
from caseloom.llm.quality_rules import apply_rules, fit_rules
from caseloom.llm.sharding import shard_rows
from caseloom.llm.source_audit import divergence_audit
from caseloom.llm.tokens import prefix_counts
from caseloom.llm.url_filter import Rule, after_scheme, path_of, url_verdicts
from caseloom.llm.warc import archive_folder, read_archives, write_archives
from caseloom.operators.skew import lookup_join

CONTEXT_TOKENS = 4096
# For the supplied tables only; a real key comes from a secret store.
PSEUDONYM_KEY = "key of the supplied tables"


def op1_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The sources of all documents mixed to an entropy of 0.95, in as many tokens as there are."""
    docs = table(spark, d, "documents")
    tokens = docs.agg(
        F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"))
    ).first()[0]
    return mixed_rows(docs, budget=tokens or 1)


def op2_shards(spark: SparkSession, d: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return shard_rows(table(spark, d, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page written into archives, indexed, and read back by byte ranges."""
    pages = table(spark, d, "pages")
    folder = archive_folder(pages)
    return read_archives(write_archives(pages, folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def fold(n: int) -> Column:
    """The fold of a document, by the checksum of its id as text; null without an id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_contaminated(spark: SparkSession, d: str) -> DataFrame:
    """All documents that hold passages of the benchmark, also with other numbers or names."""
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """All texts with personal data replaced by pseudonyms of the same format."""
    return pseudonymise(table(spark, d, "documents"), ["doc_id"], PSEUDONYM_KEY)


def op6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language mixtures of all documents, learned from four of five folds."""
    docs = table(spark, d, "documents")
    model = fit_languages(docs.where(fold(5) != 0))
    # A row without an id is in no learning fold.
    marked = docs.select("doc_id", "text", F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"))
    return language_mixtures(marked, ["doc_id", "held_out"], model).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all documents and the verdict of a decision list learned from the labels."""
    docs = table(spark, d, "documents")
    return apply_rules(docs, ["doc_id"], fit_rules(docs, table(spark, d, "labels")))


def op8_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Quality scores of all documents, learned from two of three folds."""
    docs = table(spark, d, "documents")
    model = fit_compression_model(docs, table(spark, d, "labels"), fold(3) != 1)
    marked = docs.select("doc_id", "text", F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out"))
    return score_quality(marked, ["doc_id", "held_out"], model).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op9_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents with a similarity of 0.85 on shingles of three words."""
    return near_duplicates(table(spark, d, "documents"), width=3, percent=85)


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document: the last entry of its prefix counts."""
    counted = prefix_counts(
        table(spark, d, "documents").withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")),
        public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "_bytes"], arrays=False,
    )
    return counted.select(
        "doc_id", F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit")
    )


def op11_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that tell them apart."""
    return divergence_audit(table(spark, d, "documents"))


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its family's head."""
    trie = with_ends(prefix_trie(*rebuilt(turn_rows(table(spark, d, "conversations")))))
    return trie.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


URL_RULES = [
    Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")
]


def op13_url_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """All pages judged by the rules, then by the list of URLs of toxic documents.

    A page shows the document whose number ends its path. A document labelled toxic lists its URLs.
    """
    pages = table(spark, d, "pages")
    number = F.regexp_extract(path_of(after_scheme(F.col("url"))), "/([0-9]+)([.]html)?/?$", 1).try_cast("bigint")
    toxic = table(spark, d, "labels").where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("_doc")).distinct()
    listed = lookup_join(pages.select("page_id", "url", number.alias("_doc")), toxic, "_doc", "page_id", "left_semi")
    return url_verdicts(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "canonical")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixture, op2_shards, op3_warc, op4_contaminated, op5_pseudonyms, op6_languages, op7_quality_rules,
        op8_quality_scores, op9_near_duplicates, op10_token_counts, op11_source_divergence, op12_prefix_trie,
        op13_url_verdicts,
    )
}
