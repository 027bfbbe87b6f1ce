"""Audit records: counters, the last record of a question, history, and notes made of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

HISTORY = 500
# Classes of warnings that make an answer unusable.
FAILING = ["TRUNCATED", "LOOP", "EMPTY ANSWER"]


def counters(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """answered, gate_refused, model_refused, errors, warned, tokens of audit records, for each group."""
    failed = F.col("error").isNotNull()
    refusal = X.is_refusal(F.col("answer"))
    return audit.groupBy(*(by or [])).agg(
        F.count_if(~failed & ~F.col("refused") & ~refusal).alias("answered"),
        F.count_if(~failed & F.col("refused")).alias("gate_refused"),
        F.count_if(~failed & ~F.col("refused") & refusal).alias("model_refused"),
        F.count_if(failed).alias("errors"),
        F.count_if(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0).alias("warned"),
        F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("tokens"),
    )


def last_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The last row of each key. An aggregate by max_by, so that repeats are reduced before they are shuffled."""
    every = F.struct(*rows.columns)
    return rows.groupBy(key.alias("_key")).agg(F.max_by(every, F.col(order)).alias("_row")).select("_row.*")


def history(lines: DataFrame, by: str, order: str, line: str, most: int = HISTORY) -> DataFrame:
    """The last lines of each owner without repeats of the line just before."""
    w = Window.partitionBy(by).orderBy(order)
    kept = lines.withColumn("_before", F.lag(line).over(w)).where(~F.col(line).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")
    return kept.withColumn("_age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_age") <= most).drop("_age")


def encode_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def decode_line(text: Column) -> Column:
    """encode_line() undone in one pass: what is left and right of escaped backslashes is decoded apart."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def note_blocker(audit: DataFrame) -> DataFrame:
    """Adds blocker: why a record can't become a note, or null."""
    bad = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.greatest(*(F.startswith(w, F.lit(f)) for f in FAILING)))
    blocker = (
        F.when(F.col("refused") | X.is_refusal(F.coalesce("answer", F.lit(""))), "nothing to note: the last answer was a refusal")
        .when(F.size(bad) > 0, F.concat(F.lit("not saved: the last answer is not usable ("), F.split_part(F.get(bad, F.lit(0)), F.lit(":"), F.lit(1)), F.lit(")")))
        .when(F.trim(F.coalesce("answer", F.lit(""))) == "", "nothing to note: the last answer is empty")
    )
    return audit.withColumn("blocker", blocker)


def note_names(audit: DataFrame) -> DataFrame:
    """Adds note: <day>-<slug>.md, with -2, -3 and so on for further notes of a name."""
    stem = F.concat_ws("-", F.left("ts", F.lit(10)), X.note_slug(F.col("question")))
    k = F.row_number().over(Window.partitionBy("_stem").orderBy("ts", "qid"))
    named = audit.withColumn("_stem", stem).withColumn("_k", k)
    return named.withColumn("note", F.concat("_stem", F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""), F.lit(".md"))).drop("_stem", "_k")


NOTE_HEAD = "<!-- DERIVED NOTE: written by a language model from the sources below, and no source itself. Check each number against its source. -->"


def rendered_notes(audit: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, note, text) of records that may become notes: the header of a derived note, the sources, the question, the answer resolved.

    sources: qid, label, file, heading.
    """
    from .verify import resolve_citations

    named = note_names(note_blocker(audit).where("blocker is null"))
    line = F.concat(F.lit("  - S"), F.col("label").cast("string"), F.lit(": "), F.concat_ws(" > ", "file", F.coalesce(F.nullif("heading", F.lit("")), F.lit("(no heading)"))))
    lists = sources.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", line.alias("l")))), lambda x: x["l"]), "\n").alias("_list"))
    answers = resolve_citations(named.select("qid", "answer"), sources).withColumnRenamed("answer", "_answer")
    q = F.trim(F.regexp_replace("question", r"\s+", " "))
    warned = F.coalesce(F.nullif(F.array_join("warnings", "; "), F.lit("")), F.lit("none"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Note: "), F.left(q, F.lit(120))), F.lit(""), F.lit(NOTE_HEAD), F.lit(""), F.lit("- kind: model-note"), F.concat(F.lit("- written: "), "ts"), F.concat(F.lit("- warnings: "), warned),
        F.lit("- sources:"), F.coalesce("_list", F.lit("")), F.lit(""), F.lit("## Question"), F.lit(""), q, F.lit(""), F.lit("## Answer"), F.lit(""), "_answer", F.lit(""),
    )
    return named.join(lists, "qid", "left").join(answers, "qid").select("qid", "note", text.alias("text"))


def listed(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes (note, text) with their first heading and whether they are indexed."""
    head = F.trim(F.regexp_extract("text", r"(?m)^#+\s+(.*)$", 1))
    known = files.select(F.col("file").alias("note"), F.lit(True).alias("_in"))
    return notes.join(known, "note", "left").select("note", head.alias("heading"), F.coalesce("_in", F.lit(False)).alias("indexed"))


def used_chunks(hits: DataFrame) -> DataFrame:
    """(qid, chunks): what each question got to read, in its order, as a record keeps it. hits: qid, label, chunk_id, file, heading, bm25, cos."""
    one = F.struct(F.col("chunk_id").alias("id"), "file", "heading", F.round("bm25", 3).alias("score"), F.round("cos", 3).alias("cos"))
    return hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", one.alias("c")))), lambda x: x["c"]).alias("chunks"))


def without(notes: DataFrame, name: str) -> DataFrame:
    """Notes (note, text) without one, given by its name with or without .md; the others as they are."""
    return notes.where(~F.col("note").isin(name, f"{name}.md"))


def append(records: DataFrame, path: str, machine: str) -> None:
    """Append-only JSON lines, a folder for each machine, so that no two writers share a file."""
    records.withColumn("machine", X.machine_slug(F.lit(machine))).write.mode("append").partitionBy("machine").json(path)
