"""Streams: the audit log's tail, incremental indexing, and answers that arrive in frames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK_EVERY, TAIL, WINDOW, TIMES = 50, 300, 3600, 3
#: Files of one part of what arrives, at most.
PART_FILES = 4


def audit_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)


def event_counters(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type of events (ts, event_id, event_type, value), repeats within the watermark dropped. For batches and streams alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        timed = timed.dropDuplicates(["event_id"])
    g = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def follow_counters(events: DataFrame, path: str, checkpoint: str, window: str = "1 hour", late: str = "2 hours"):
    """A query that keeps counts by window and type of a stream of events at path, each event once, whatever is replayed.

    Each batch's changed windows are written to a folder of their own, named by the batch's number, and only a number that the commit log doesn't have: after a
    failure, a batch that is given again finds itself logged, or writes its folder anew before it is logged.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in committed(spark, path):
            batch.write.format("noop").mode("overwrite").save()  # the state of the batch is made all the same
            return
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/{number}")
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{number}")

    return event_counters(events, window, late).writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrive(rows: DataFrame, parted: str, path: str) -> int:
    """Write rows to path, a folder for each part, one part after another in their order; the files of a part, at most.

    rows are read once, and each part's own are then read from the place parted. A part has few files however large it is, so that a stream that takes as many at a time
    has a batch for each part, and no more of them for more rows.
    """
    spark = rows.sparkSession
    rows.write.partitionBy("part").parquet(parted)
    schema = rows.drop("part").schema
    for k in [r["part"] for r in spark.read.parquet(parted).select("part").distinct().orderBy("part").collect()]:
        spark.read.schema(schema).parquet(f"{parted}/part={k}").coalesce(PART_FILES).write.mode("append").parquet(f"{path}/{k:06d}")
    return PART_FILES


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def committed(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the batches that are whole; one for each micro-batch."""
    log = _stored(spark, f"{path}/log")
    return {r["batch"] for r in log.collect()} if log is not None else set()


def current_counters(spark: SparkSession, path: str) -> DataFrame:
    """(start, event_type, n, total) as of the last committed batch: of each window its newest row."""
    log = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/log")
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/changes").join(log, "batch", "left_semi")
    newest = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("c"))
    return newest.select("start", "event_type", "c.n", "c.total")


def upsert_index(batch: DataFrame, path: str) -> None:
    """Of a batch of files (file, sha256, text), write what is new or changed, a folder for each generation.

    A reader takes the newest row of each file. Files whose newest hash is the same are left out; of the stored rows only names, hashes and times are
    read for that. A file without a hash is gone: its newest row has neither hash nor text.
    """
    spark = batch.sparkSession
    try:
        stored = spark.read.parquet(path).groupBy("file").agg(F.max_by(F.struct("sha256"), "seen").alias("_s")).select("file", F.col("_s.sha256").alias("_have"))
        batch = batch.join(stored, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("_have"))).drop("_have")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # else there is no generation yet
    batch.withColumn("seen", F.current_timestamp()).write.mode("append").parquet(path)


def latest(index: DataFrame) -> DataFrame:
    """The newest row of each file that isn't gone."""
    row = F.max_by(F.struct(*index.columns), F.col("seen"))
    return index.groupBy("file").agg(row.alias("_r")).select("_r.*").where("sha256 is not null")


def follow_folder(files: DataFrame, path: str, checkpoint: str):
    """A query that keeps the index at path up to date with a stream of files."""
    return files.writeStream.foreachBatch(lambda b, _: upsert_index(b, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_frames(lines: Iterable[str]) -> dict:
    """An answer from the lines of its event stream: text, usage, finish, error. A repeating text ends it with 'loop', and no further line is read."""
    text, usage, thought, finish, error, parts = "", None, None, None, None, 0
    for line in lines:
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            break
        try:
            frame = json.loads(data)
        except ValueError:
            continue
        if "error" in frame:
            e = frame["error"]
            error = e.get("message", str(e)) if isinstance(e, dict) else str(e)
            break
        used = frame.get("usage") or {}
        usage = used.get("total_tokens", usage)
        thought = (used.get("completion_tokens_details") or {}).get("reasoning_tokens", thought)
        for choice in frame.get("choices") or []:
            piece = (choice.get("delta") or {}).get("content") or ""
            text += piece
            parts += bool(piece)
            finish = choice.get("finish_reason") or finish
        if parts and parts % CHECK_EVERY == 0 and len(text) >= TAIL and text[-WINDOW:].count(text[-TAIL:]) >= TIMES:
            finish = "loop"
            break
    if not text and usage is None and finish is None and error is None:
        error = "empty stream"
    return {"answer": text, "tokens": usage, "reasoning_tokens": thought, "finish": finish, "error": error}


_ANSWER = "answer_id long, answer string, tokens long, finish string, error string"


def _folded(answer_id: int, lines: Iterable[str], **more) -> pd.DataFrame:
    out = fold_frames(lines) | more
    return pd.DataFrame([(answer_id, out["answer"], out["tokens"], out["finish"], out["error"])], columns=["answer_id", "answer", "tokens", "finish", "error"]).astype({"tokens": "Int64"})


def answers(frames: DataFrame) -> DataFrame:
    """Recorded frames (answer_id, seq, line) -> answers."""
    return frames.groupBy("answer_id").applyInPandas(lambda key, rows: _folded(key[0], rows.sort_values("seq")["line"].tolist()), _ANSWER)


def answers_stream(frames: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """The same for a stream. An answer is given out at its end marker, at an error, or as soon as its text repeats, when later frames are no longer kept.

    An answer that gets no frame for patience_ms is given out as it is, with the error 'no end'. What has been given out is forgotten
    after the same time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, over = state.get if state.exists else ([], False)
        if state.hasTimedOut:
            state.remove()
            if not over:
                yield _folded(key[0], [x[12:] for x in sorted(held)], error="no end")
            return
        held = list(held)
        for b in batches:
            held += [f"{int(s):012d}{x}" for s, x in zip(b["seq"], b["line"], strict=True)]
        if not over:
            lines = [x[12:] for x in sorted(held)]
            ended = any(x.startswith("data:") and (x[5:].strip() == "[DONE]" or '"error"' in x) for x in lines)
            if ended or fold_frames(lines)["finish"] == "loop":
                over = True
                yield _folded(key[0], lines)
        state.update(([] if over else held, over))
        state.setTimeoutDuration(patience_ms)

    return frames.groupBy("answer_id").applyInPandasWithState(step, _ANSWER, "held array<string>, over boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
