"""Many phrases in many texts: an Aho-Corasick automaton that is broadcast, and one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the phrases of one automaton; a longer list is cut into parts of that size, each with a pass of its own.
PART_BYTES = 16 << 20


def phrases_in(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """texts and phrases (phrase) -> (*keys, phrase): the phrases that each row's text holds, each once, whatever the case of letters.

    Containment, also within words: callers look at what stands around. The time is that of reading the texts and of what is found, for any number of
    phrases: common words of theirs cost nothing, as no row is made for a word. Null or empty texts and phrases match nothing. Repeated rows match each.
    """
    import ahocorasick

    spark = texts.sparkSession
    said = phrases.where("phrase is not null and phrase <> ''").select("phrase").distinct()
    size = said.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    kind = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys) + ", phrase string"
    found = []
    for k in range(parts):
        words = ahocorasick.Automaton()
        same: dict[str, list[str]] = {}
        for r in said.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k).collect():
            same.setdefault(r["phrase"].lower(), []).append(r["phrase"])
        for low, written in same.items():
            words.add_word(low, written)
        words.make_automaton()
        sent = spark.sparkContext.broadcast(words)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, names = [], []
                for i, t in enumerate(b.column(len(keys))):
                    held = {id(w): w for _, w in sent.value.iter((t.as_py() or "").lower())} if len(sent.value) else {}
                    for written in held.values():
                        rows += [i] * len(written)
                        names += written
                kept = b.select(range(len(keys))).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string())], [*keys, "phrase"])

        found.append(texts.select(*keys, F.col(text).alias("_searched")).mapInArrow(match, kind))
    return reduce(DataFrame.union, found)
