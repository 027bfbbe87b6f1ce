"""SimHash fingerprints, links by multi-index hashing, groups of near copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise
from .components import components, looked_up

SEED = 42
#: A fingerprint is cut into two segments of 32 bits. Of two fingerprints at distance 2 or less, one segment differs in 1 bit or none.
SEGMENT_BITS, RADIUS = 32, 1
#: Buckets of a segment table above this size are matched by whole-fingerprint balls instead (see links()).
BUCKET_ROWS = 32
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of all shingles of A-Z-lowered words; 0 without words. Signed, as Spark's long."""
    import xxhash

    digest = xxhash.xxh64_digest
    w = text.lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        parts = [joined]
    else:
        ends = list(accumulate(map(len, w)))
        ends = [e + i for i, e in enumerate(ends)]
        parts = [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :], strict=False)]
    return majority(b"".join([digest(p, SEED) for p in parts]))


def majority(hashes: bytes) -> int:
    """Of 64-bit hashes (big-endian, one after another) the bits that are set in over half of them; 0 without hashes. Signed, as Spark's long."""
    ones, n = np.zeros(64, np.int64), len(hashes) // 8
    for i in range(0, n, _CHUNK):
        raw = np.frombuffer(hashes, np.uint8, 8 * min(_CHUNK, n - i), 8 * i).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = [fingerprint(t.as_py(), words) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """documents -> (doc_id, fp long), a row for each row. Null, empty and white-space texts: fp 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, words), f"doc_id {kind}, fp long")


def _segment(fp, s):
    return F.when(s == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all pairs at distance 2 or less.

    Multi-index hashing: a table for each segment; each fingerprint enumerates the ball of radius 1 around each of its
    segments, fetches the matching buckets and verifies the whole distance. The ball is enumerated upwards only (set bits that
    are 0): of two segments at distance 1, exactly one reaches the other so.

    A bucket of over bucket_rows fingerprints would make pairs with the square of its size. Its fingerprints, and those that
    reach it, are matched through the ball of radius 1 around the whole fingerprint (both segments' balls, with the other segment
    as part of the key) instead: two fingerprints are within 2 bits if and only if they share a member of their balls. At
    most 65 distinct fingerprints have a given member, all within 2 bits of each other, so a star to the least of them
    connects them. This is exact as well and has no large group, whatever the data.
    """
    fp = F.col("fp")
    tables = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select("fp", "s", _segment(fp, F.col("s")).alias("seg"))
    buckets = tables.groupBy("s", "seg").agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    flips = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS))))
    probes = (
        tables.select("fp", "s", "seg", flips.alias("flip"))
        .where(F.col("seg").bitwiseAND(F.col("flip")) == 0)
        .select("fp", "s", F.col("seg").bitwiseOR(F.col("flip")).alias("seg"))
    )
    # neither side may be broadcast: Spark sizes the probes as if each fingerprint had one, but it has some 34
    hits = materialise(probes.hint("merge").join(buckets, ["s", "seg"]).where("n > 1 or one != fp"), "simhash-hits")
    single = hits.where("n = 1").select("fp", F.col("one").alias("other"))
    few = hits.where(f"n > 1 and n <= {bucket_rows}").select("fp", "s", "seg").join(tables.withColumnRenamed("fp", "other").hint("merge"), ["s", "seg"]).select("fp", "other")
    near = single.union(few).where("fp != other and bit_count(fp ^ other) <= 2").select(F.col("fp").alias("u"), F.col("other").alias("v"))
    ball = F.explode(F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64))))
    crowded = hits.where(f"n > {bucket_rows}").select("fp").distinct()
    members = crowded.select("fp", ball.alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("member"))
    shared = members.groupBy("member").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = shared.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u != v and bit_count(u ^ v) <= 2").select("u", "v")
    return near.union(stars)


def groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """documents -> (doc_id, fp, component_id), a row for each row.

    component_id: the smallest non-null doc_id reachable over links, its own included (null if there is none). Equal
    fingerprints, those of empty texts too, are one node: copies are never expanded into pairs. Repeated rows get equal values.
    An empty table gives an empty table.
    """
    prints = materialise(fingerprints(docs, words), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    own = roots.join(nodes, "fp")
    merged = own.groupBy("root").agg(F.min("least").alias("reached")).join(roots, "root").select("fp", "reached")
    ids = materialise(nodes.join(merged, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"), "n"), "simhash-ids")
    return looked_up(prints, ids, "fp").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of the rows of documents, one for each doc_id that is its own component_id in grouped, and those whose doc_id is null."""
    key, row = fresh(docs, "kept_id"), fresh(docs, "kept_row")
    kept = grouped.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    one = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(docs["text"])))
    named = docs.join(kept, docs["doc_id"] == kept[key]).withColumn(row, one).where(F.col(row) == 1)
    return named.select(*(docs[c] for c in docs.columns)).union(docs.where("doc_id is null"))


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of documents, all columns unchanged, without near copies: of each group the row with its smallest doc_id stays.

    Of repeated rows with that doc_id one stays (the one with the least hash of its text). Rows whose doc_id is null all stay.
    """
    return keep_least(docs, groups(docs.where("doc_id is not null"), words))
