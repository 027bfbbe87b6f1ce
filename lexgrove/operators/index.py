"""The persisted term index: postings, chunk lengths, document frequencies, corpus statistics, and when to rebuild it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import parts

CHUNK_VERSION = 1
#: Characters of text that a task counts the terms of; it holds some thirty bytes for each.
TASK_CHARACTERS = 16_000_000


def chunks_of(docs: DataFrame) -> DataFrame:
    """documents as chunks: the source is the folder, the language the heading, doc_id the place in the corpus."""
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("lang").alias("heading"), "text", F.col("doc_id").alias("corpus_pos")
    )


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term), a row for each token."""
    return X.terms(chunks, X.chunk_text(F.col("text"), F.col("heading"), F.col("file")), "chunk_id")


def text_parts(chunks: DataFrame) -> int:
    """Partitions that the chunks' texts are dealt out to, by their characters."""
    return parts(chunks, TASK_CHARACTERS, F.coalesce(F.length("text"), F.lit(0)) + 64)


def postings(chunks: DataFrame, n: int | None = None) -> DataFrame:
    """(chunk_id, term, tf, n_tokens). Texts are dealt out by chunk first, to n tasks (by default as many as their characters ask for), so that terms and lengths are counted where they are and nothing else is shuffled."""
    tf = chunk_terms(chunks.repartition(n or text_parts(chunks), "chunk_id")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("n_tokens", F.sum("tf").over(Window.partitionBy("chunk_id")))


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_tokens) of all chunks, those without a token too."""
    found = chunk_terms(chunks).groupBy("chunk_id").agg(F.count("*").alias("n_tokens"))
    return _all_lengths(chunks, found)


def _all_lengths(chunks: DataFrame, found: DataFrame) -> DataFrame:
    return chunks.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"))


def lengths_of(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same from postings, without reading a text again."""
    return _all_lengths(chunks, posts.groupBy("chunk_id").agg(F.any_value("n_tokens").alias("n_tokens")))


def document_frequency(posts: DataFrame) -> DataFrame:
    """Chunks with each term. A posting is one per chunk and term, so a count is enough."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def statistics_of(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """corpus_statistics() from postings: their tf add up to all tokens, and chunks are only counted."""
    n = chunks.agg(F.count("*")).scalar()
    total = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens")).select(n.alias("n_chunks"), "n_tokens")
    return total.select("n_chunks", "n_tokens", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_chunks")).alias("avg_tokens"))


def corpus_statistics(chunk_lengths: DataFrame) -> DataFrame:
    return chunk_lengths.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.avg("n_tokens").alias("avg_tokens"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, status): added, removed, changed or same, of two tables (file, sha256)."""
    o, n = old.select("file", F.col("sha256").alias("_old")), new.select("file", F.col("sha256").alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return o.join(n, "file", "full_outer").select("file", status.alias("status"))


def up_to_date(changes: DataFrame, old_version: int, had_vectors: bool, embedder: bool) -> bool:
    """No change of files, the same chunk version, and vectors unless there is nothing to make them with."""
    return old_version == CHUNK_VERSION and (had_vectors or not embedder) and changes.where("status <> 'same'").isEmpty()
