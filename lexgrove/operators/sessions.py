"""Session memory: the last kept turn of a user's session goes with the next question. For batches by windows, for streams by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A session ends when a user is silent for so long, in minutes.
GAP_MINUTES = 30


def sessions(turns: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """turns (user, ts, seq, question, answer, refused) -> (user, start, end, turns, kept) of each session."""
    g = turns.groupBy("user", F.session_window("ts", f"{gap} minutes").alias("w"))
    return g.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("turns"), F.count_if(_kept()).alias("kept")).drop("w")


def _kept():
    """A turn is remembered if it wasn't refused and has an answer."""
    return ~F.coalesce("refused", F.lit(False)) & (F.coalesce("answer", F.lit("")) != "")


def remembered(turns: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """turns (user, ts, seq, question, answer, refused) -> the same with session (when it began), previous (seq, question, answer; null if none) and query.

    previous is the last turn of the same session that was kept; query is the text that is searched for: the question, and the previous one behind it. A turn
    follows another of its session if it comes less than gap minutes after it; turns of one time go by seq. Rows without a user or a time stay without session.

    A user's hours are looked at apart and meet by one summary row each, so that a user with any share of all turns is spread over tasks.
    """
    far = F.expr(f"interval {gap} minutes")
    rows = turns.where("user is not null and ts is not null").withColumn("_hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("user", "_hour").orderBy("ts", "seq")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(_kept(), F.struct("ts", "seq", "question", "answer"))
    rows = rows.withColumn("_last", F.lag("ts").over(inside)).withColumn("_kept", F.last(kept, ignorenulls=True).over(before)).withColumn("_first", F.row_number().over(inside) == 1)
    hours = turns.where("user is not null and ts is not null").groupBy("user", F.date_trunc("hour", "ts").alias("_hour")).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.max(F.when(_kept(), F.struct("ts", "seq", "question", "answer"))).alias("_k"))
    over = Window.partitionBy("user").orderBy("_hour")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("user", "_hour", F.lag("_to").over(over).alias("_to_before"), F.last("_k", ignorenulls=True).over(earlier).alias("_k_before"))
    rows = rows.join(hours, ["user", "_hour"])
    rows = rows.withColumn("_last", F.when(F.col("_first"), F.col("_to_before")).otherwise(F.col("_last")))
    rows = rows.withColumn("_begin", F.when(F.col("_last").isNull() | (F.col("ts") >= F.col("_last") + far), F.col("ts")))
    begun = rows.where("_begin is not null").groupBy("user", "_hour").agg(F.max("_begin").alias("_b"))
    begun = hours.select("user", "_hour").join(begun, ["user", "_hour"], "left").select("user", "_hour", F.last("_b", ignorenulls=True).over(earlier).alias("_begun"))
    rows = rows.join(begun, ["user", "_hour"]).withColumn("session", F.coalesce(F.last("_begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_begun"))
    last = F.coalesce("_kept", "_k_before")
    previous = F.when(last["ts"] >= F.col("session"), F.struct(last["seq"].alias("seq"), last["question"].alias("question"), last["answer"].alias("answer")))
    rows = rows.withColumn("previous", previous)
    rest = turns.where("user is null or ts is null")
    rest = rest.withColumn("session", F.lit(None).cast("timestamp")).withColumn("previous", F.lit(None).cast(rows.schema["previous"].dataType))
    every = rows.select(*turns.columns, "session", "previous").union(rest.select(*turns.columns, "session", "previous"))
    return every.withColumn("query", F.concat_ws(" ", "question", "previous.question"))


def remembered_stream(turns: DataFrame, gap: int = GAP_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The same for a stream of turns with a long user and seq, with the previous turn's seq and question and the query; a user's state is one turn, and goes when the session has ended.

    Turns of one batch are put in order; a turn that comes in a later batch than its followers in time doesn't change what these were given.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    apart = pd.Timedelta(minutes=gap)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, began, seq, question = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for t in rows.itertuples(index=False):
            if last is None or t.ts >= pd.Timestamp(last) + apart:
                began, seq, question = t.ts, None, None
            out.append((t.user, t.ts, t.seq, began, seq, question, t.question if question is None else f"{t.question} {question}"))
            last = t.ts if last is None else max(pd.Timestamp(last), t.ts)
            if not t.refused and t.answer:
                seq, question = int(t.seq), t.question
        state.update((last, began, seq, question))
        state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + int(apart.total_seconds() * 1000) + 1)
        made = pd.DataFrame(out, columns=["user", "ts", "seq", "session", "previous_seq", "previous_question", "query"])
        yield made.astype({"previous_seq": "Int64"})

    kind = "user long, ts timestamp, seq long, session timestamp, previous_seq long, previous_question string, query string"
    held = "last timestamp, began timestamp, seq long, question string"
    timed = turns.select("user", "ts", "seq", "question", "answer", "refused").withWatermark("ts", late)
    return timed.groupBy("user").applyInPandasWithState(step, kind, held, "append", GroupStateTimeout.EventTimeTimeout)
