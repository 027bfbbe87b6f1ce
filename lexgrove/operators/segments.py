"""The incremental index: segments of postings with tombstones, deltas of statistics summed at read, and size-tiered merging.

Each batch of changed files becomes a segment of its own: their chunks, postings and lengths, the chunks that they replace (dead), and by how much
document frequencies and totals change. Every row says which batch made it (seg), and a dead chunk kills what older batches have of it; so segments may be
merged in any order, and a reader sums and filters what it reads. No text of an unchanged file is ever read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep, remove
from . import index as I

#: So many segments of one size class, each FAN times the one below, become one.
FAN = 4
#: Postings that a task sorts when segments are merged.
TASK_POSTINGS = 2_000_000


@dataclass
class Segments:
    """An index at a path. A manifest for each version names its segments; it is written last, so that a batch is there as a whole or not at all.

    makers: further parts of each segment, as functions from chunks to rows with a chunk_id, such as vectors.
    """

    spark: SparkSession
    path: str
    makers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def _manifest(self) -> tuple[int, list]:
        """The newest version and its segments: name, seg (the last batch in it), postings. 0 and none if nothing is there."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0, []
        found = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).orderBy("seg").collect()
        return (found[0]["version"], [r for r in found if r["name"]]) if found else (0, [])

    def _commit(self, version: int, segments: list[tuple[str, int, int]]) -> None:
        rows = [(version, *s) for s in segments] or [(version, None, 0, 0)]
        self.spark.createDataFrame(rows, "version int, name string, seg int, postings long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, part: str, names: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{n}/{part}" for n in names))

    def _live(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows (chunk_id, seg, ...) that no later batch has replaced. The dead are as many as chunks were ever replaced since the last full merge."""
        dead = self._read("dead", names).groupBy("chunk_id").agg(F.max("seg").alias("_dead"))
        return rows.join(dead, (rows["chunk_id"] == dead["chunk_id"]) & (rows["seg"] < dead["_dead"]), "left_anti")

    def _names(self) -> list[str]:
        names = [s["name"] for s in self._manifest()[1]]
        if not names:
            raise LookupError(f"no index in {self.path}")
        return names

    def live(self, part: str) -> DataFrame:
        """Current rows of chunks, postings, lengths or a further part."""
        names = self._names()
        return self._live(self._read(part, names), names)

    def files(self) -> DataFrame:
        """(file, sha256) of the indexed files."""
        newest = self._read("files", self._names()).groupBy("file").agg(F.max_by(F.struct("sha256"), "seg").alias("f"))
        return newest.select("file", F.col("f.sha256").alias("sha256")).where("sha256 is not null")

    def document_frequency(self) -> DataFrame:
        """(term, df): the segments' deltas, summed."""
        return self._read("df", self._names()).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> DataFrame:
        """(n_chunks, n_tokens, avg_tokens): the segments' deltas, summed."""
        t = self._read("totals", self._names()).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
        return t.select("n_chunks", "n_tokens", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_chunks")).alias("avg_tokens"))

    def apply(self, batch: DataFrame, chunks: DataFrame) -> int:
        """Index a batch of files (file, sha256; without sha256 a file is gone) and the chunks (chunk_id, file, heading, text, ...) of them; how many files differed.

        Files with the hash that is stored are left out, and so are their chunks. Of repeated files any one counts.
        """
        version, segments = self._manifest()
        names, seg = [s["name"] for s in segments], version + 1
        batch = batch.select("file", "sha256").dropDuplicates(["file"])
        if names:
            batch = batch.join(self.files().withColumnRenamed("sha256", "_have"), "file", "left").where(~F.col("sha256").eqNullSafe(F.col("_have"))).drop("_have")
        changed = keep(batch, "changed")
        n = changed.count()
        if not n:
            return 0
        name = f"segment-{uuid.uuid4().hex}"
        write = lambda rows, part: rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{part}")
        at = F.lit(seg).alias("seg")
        write(changed.select("file", "sha256", at), "files")
        write(chunks.join(changed.where("sha256 is not null").select("file"), "file", "left_semi").select("*", at), "chunks")
        own = self._read("chunks", [name])
        n_parts = I.text_parts(own)
        posts = I.postings(own, n_parts).select("term", "chunk_id", "tf", "n_tokens", at)
        write(posts.repartition(n_parts, "term").sortWithinPartitions("term", "chunk_id"), "postings")
        posts = self._read("postings", [name])
        lengths = I.lengths_of(posts, own).join(own.select("chunk_id", "file"), "chunk_id").select("chunk_id", "file", "n_tokens", at)
        write(lengths, "lengths")
        for part, made in self.makers.items():
            write(made(own).select("*", at), part)
        more = posts.groupBy("term").agg(F.count("*").alias("df"))
        lengths = self._read("lengths", [name])
        totals = lengths.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        if names:
            gone = keep(self._live(self._read("lengths", names), names).join(changed.select("file"), "file", "left_semi").select("chunk_id", "n_tokens"), "gone")
            write(gone.select("chunk_id", at), "dead")
            old = self._live(self._read("postings", names).join(gone.select("chunk_id"), "chunk_id", "left_semi"), names)
            more = more.union(old.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            less = gone.agg((-F.count("*")).alias("n_chunks"), -F.coalesce(F.sum("n_tokens"), F.lit(0)))
            totals = totals.union(less).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
        else:
            write(own.limit(0).select("chunk_id", at), "dead")
        write(more, "df")
        write(totals, "totals")
        every = [*((s["name"], s["seg"], s["postings"]) for s in segments), (name, seg, posts.count())]
        self._commit(seg, every)
        self._merge(seg, every)
        return n

    def _merge(self, version: int, segments: list[tuple[str, int, int]]) -> None:
        """While FAN segments are of one size class, they become one, without what is dead."""
        classes: dict[int, list] = {}
        for s in segments:
            classes.setdefault(max(s[2], 1).bit_length() // FAN.bit_length(), []).append(s)
        full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
        if full:
            self.merge(version, segments, full)

    def merge(self, version: int, segments: list[tuple[str, int, int]], some: list[tuple[str, int, int]]) -> None:
        """Some of a version's segments as one, under the same version's batches: rows keep the batch that made them."""
        names, every, name = [s[0] for s in some], [s[0] for s in segments], f"segment-{uuid.uuid4().hex}"
        write = lambda rows, part: rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{part}")
        live = lambda part: self._live(self._read(part, names), every)
        write(live("chunks"), "chunks")
        n_parts = max(self.spark.sparkContext.defaultParallelism, -(-sum(s[2] for s in some) // TASK_POSTINGS))
        write(live("postings").repartition(n_parts, "term").sortWithinPartitions("term", "chunk_id"), "postings")
        for part in ("lengths", *self.makers):
            write(live(part), part)
        newest = self._read("files", names).groupBy("file").agg(F.max_by(F.struct("sha256", "seg"), "seg").alias("f")).select("file", "f.sha256", "f.seg")
        whole = len(some) == len(segments)
        write(newest.where("sha256 is not null") if whole else newest, "files")
        dead = self._read("dead", names)
        write(dead.limit(0) if whole else dead.groupBy("chunk_id").agg(F.max("seg").alias("seg")), "dead")
        write(self._read("df", names).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "df")
        write(self._read("totals", names).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")), "totals")
        left = [s for s in segments if s not in some]
        merged = (name, max(s[1] for s in some), self._read("postings", [name]).count())
        self._commit(version + 1, sorted([*left, merged], key=lambda s: s[1]))

    def vacuum(self) -> list[str]:
        """Remove the segments that the newest version doesn't name; readers of older versions must be done."""
        rows = self.spark.read.parquet(f"{self.path}/manifest")
        old = sorted({r["name"] for r in rows.select("name").distinct().collect() if r["name"]} - set(self._names()))
        return [name for name in old if remove(self.spark, f"{self.path}/{name}")]


def bm25_inputs(index: Segments) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What retrieve.bm25 reads: postings, statistics, document frequencies."""
    return index.live("postings").select("chunk_id", "term", "tf", "n_tokens"), index.statistics(), index.document_frequency()
