"""How five filters overlap: failure masks of all documents, exact duplicates by sorting, and counts for all orders of the filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A: under 200 words. B: under half of the words are distinct. C: over 2 in 100 characters are capitals. D: holds a sign. E: a copy.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_DUPLICATE = 1 << FILTERS.index("E")


def own_failures(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, part, mask, text), a row for each row: bit k of mask says that the text fails filter k on its own account (all but E). Null texts are empty ones."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_w", words).select("*", F.size("_w").alias("_n"), F.size(F.array_distinct("_w")).alias("_d")).drop("_w")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [F.col("_n") < MIN_WORDS, 100 * F.col("_d") < MIN_DISTINCT_PERCENT * F.col("_n"), 100 * capitals > MAX_CAPITALS_PERCENT * F.length("text"), F.col("text").rlike(SIGNS)]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), "text")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, doc_id, part, mask) of one partition -> the rows (doc_id, part, mask) with E's bit where a row before decides it.

    What a partition before may decide has a key, a digest of the text: rows whose text hash is the partition's first one. A row without part
    tells other partitions of a text: its key and the least doc_id here. Only texts with the partition's first or last hash can go on elsewhere.
    """
    first_fp = fp = text = least = None
    tells: list[tuple[bytes, int | None]] = []  # the texts of this hash, for other partitions
    digest = lambda t: hashlib.sha256(t).digest()
    told: list[tuple[bytes, int | None]] = []

    def close() -> None:
        if text is not None:
            tells.append((text, least))

    for b in batches:
        fps, ids = b.column(0).to_numpy(), b.column(2).to_pylist()
        texts, masks = b.column(1).cast(pa.binary()), b.column(4).to_numpy().copy()
        keys: list[bytes | None] = [None] * len(b)
        for i, (f, t) in enumerate(zip(fps.tolist(), texts.to_pylist(), strict=True)):
            if f != fp:
                close()
                if fp is not None and fp == first_fp:
                    told += [(digest(x), y) for x, y in tells]
                tells.clear()
                first_fp = f if first_fp is None else first_fp
                fp, text, least = f, t, ids[i]
            elif t != text:
                close()
                text, least = t, ids[i]
            elif least is None:
                least = ids[i]
            elif ids[i] is not None and least < ids[i]:
                masks[i] |= _DUPLICATE
            if fp == first_fp and not masks[i] & _DUPLICATE:
                keys[i] = digest(text)
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "key"])
    close()
    if fp is not None:
        told += [(digest(x), y) for x, y in tells]
        yield pa.RecordBatch.from_arrays([pa.array([y for _, y in told], pa.int64()), pa.nulls(len(told), pa.string()), pa.nulls(len(told), pa.int32()), pa.array([x for x, _ in told], pa.binary())], ["doc_id", "part", "mask", "key"])


def failures(docs: DataFrame) -> DataFrame:
    """documents (doc_id a long) -> (doc_id, part, mask), a row for each row: the filters that each document fails, E too.

    Rows are sorted by hash of text, text and doc_id over ranges of (hash, doc_id): the copies of one text, however many, are spread over as many
    ranges as they need, and no text is part of a range's bounds. Within a range, each row is compared with the one before. Ranges
    that cut through a text's rows meet by one small row for each end of each range. The text is shuffled once; what follows has no text.
    A row without doc_id has no smaller one before it: it doesn't fail E, nor do repeated rows of the least doc_id.
    """
    rows = own_failures(docs).select(F.xxhash64("text").alias("fp"), "text", F.col("doc_id").cast("long").alias("doc_id"), "part", "mask")
    ranges = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = materialise(ranges.mapInArrow(_neighbours, "doc_id long, part string, mask int, key binary"), "filter-masks")
    ends = found.where("part is null").groupBy("key").agg(F.min("doc_id").alias("least"))
    late = found.where("part is not null and key is not null").join(ends, "key", "left")
    late = late.withColumn("mask", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(_DUPLICATE))).otherwise(F.col("mask")))
    return found.where("part is not null and key is null").select("doc_id", "part", "mask").union(late.select("doc_id", "part", "mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask) and labels (doc_id, quality, toxic) -> (part, mask, n, good, toxic): additive counts. A document is good, or toxic, if any of its labels says so."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.where("doc_id is not null").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    none = F.lit(None).cast("boolean")
    every = joined.union(rows.where("doc_id is null").select("part", "mask", none, none))
    one = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return every.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))


def _orders(filters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All orders, and for each (order, step, mask): does the document go here, has it gone before, does it fail this filter; and shapley's weight for (filter, mask)."""
    k = len(filters)
    orders = ["".join(p) for p in permutations(filters)]
    mask = np.arange(1 << k)
    bit = np.array([[1 << filters.index(c) for c in o] for o in orders])
    before = np.cumsum(bit, axis=1) - bit
    fails, gone = (mask & bit[:, :, None]) > 0, (mask & before[:, :, None]) > 0
    size = np.array([m.bit_count() for m in mask.tolist()])
    weight = np.array([[factorial(k) // size[m] if m >> f & 1 else 0 for m in mask] for f in range(k)])
    return orders, fails & ~gone, gone, fails, weight


def _audit(batches: Iterator[pa.RecordBatch], filters: str) -> Iterator[pa.RecordBatch]:
    orders, here, gone, fails, weight = _orders(filters)
    at = np.array([[filters.index(c) for c in o] for o in orders])
    alone = np.array([1 << f for f in range(len(filters))])
    steps, n_orders = len(filters), len(orders)
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n, good, toxic = (np.zeros(1 << steps, np.int64) for _ in range(3))
            for c in counts:
                n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
            columns = [(~here & ~gone) @ n, here @ n, (fails & gone) @ n, n[alone][at], here @ good, here @ toxic, (weight @ n)[at]]
            rows = n_orders * steps
            keys = [pa.array([part] * rows, pa.string()), pa.array([o for o in orders for _ in range(steps)]), pa.array(list(range(1, steps + 1)) * n_orders, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.reshape(-1), pa.int64()) for c in columns)], ["part", "filter_order", "step", *COUNTS])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic) -> for each part, order of the filters and step the counts of COUNTS, zeros too.

    A part is at most 2 ** filters rows of counts, and the orders times the steps times these decide everything: no document is looked at again.
    kept: left after this step. removed: gone here. redundant: failing this filter, but gone before. unique_fails: failing this filter only.
    good_lost, toxic_lost: gone here with that label. shapley: removed by this filter, summed over all orders.
    """
    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return gathered.mapInArrow(lambda it: _audit(it, filters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> interactions of the five filters, for each source (null: empty string). No documents: no rows. Repeated rows count each; other columns are ignored."""
    return interactions(mask_counts(failures(docs), labels))

