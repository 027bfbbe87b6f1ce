"""Corpora rendered from constants: templates, registers, checks of a corpus' source, seeded fillers, shapes of a slide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import parts
from .phrases import phrases_in

#: Short rows that a task groups, about.
TASK_ROWS = 1_000_000
PLACEHOLDER = r"\{\{(\w+):([\w.-]+)\}\}"


def render(docs: DataFrame, constants: DataFrame) -> DataFrame:
    """(doc_id, rendered, unknown): {{kind:id}} replaced by constants (kind, id, value); ids without a constant are listed and stay.

    Pieces are joined to the constants as rows, so any number of constants will do, then put together in order.
    """
    text = F.split("text", PLACEHOLDER)
    kinds, ids = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1)), F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(2))
    pieces = docs.select("doc_id", F.posexplode(F.transform(text, lambda t, i: F.struct(t.alias("t"), F.get(kinds, i).alias("kind"), F.get(ids, i).alias("id")))).alias("_i", "_p"))
    joined = pieces.select("doc_id", "_i", "_p.t", "_p.kind", "_p.id").join(constants, ["kind", "id"], "left")
    mark = F.concat(F.lit("{{"), F.col("kind"), F.lit(":"), F.col("id"), F.lit("}}"))
    piece = F.concat("t", F.when(F.col("id").isNull(), "").otherwise(F.coalesce("value", mark)))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", piece.alias("p")))), lambda x: x["p"]), "")
    unknown = F.array_join(F.sort_array(F.collect_set(F.when(F.col("id").isNotNull() & F.col("value").isNull(), F.concat_ws(":", "kind", "id")))), ",")
    return joined.groupBy("doc_id").agg(whole.alias("rendered"), unknown.alias("unknown"))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2)))


def register(timeline: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and calls of a timeline with the parties' names; and the parties without an inbound row."""
    rows = timeline.where(F.col("kind").isin("message", "call")).join(parties, "party")
    inbound = timeline.where("direction = 'in'").select("party").distinct()
    return rows, parties.join(inbound, "party", "left_anti")


def substring_collisions(amounts: DataFrame) -> DataFrame:
    """(a, b): distinct amounts (digits) of which a lies within b. Each amount gives its substrings, which meet amounts by equality."""
    d = amounts.select("digits").distinct()
    n = F.length("digits")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("digits", i, k))))
    inner = d.select(F.col("digits").alias("b"), F.explode(F.array_distinct(parts)).alias("digits"))
    return inner.join(d, "digits").where("digits <> b").select(F.col("digits").alias("a"), "b")


def undeclared(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(file, id, problem): placeholders used but not declared, and declared but not used.

    Both sides are marked and meet in one aggregate, dealt out by their rows.
    """
    mark = lambda df, side: df.select("file", "id", F.lit(side).alias("_side"))
    both = mark(used, 0).union(mark(declared, 1))
    met = both.repartition(parts(both, TASK_ROWS), "file", "id").groupBy("file", "id").agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    return met.where("_a = _b").select("file", "id", F.when(F.col("_a") == 0, "undeclared").otherwise("unused").alias("problem"))


AMOUNT_WRITTEN, ISO_DATE = r"[$€]\s?\d[\d,]*(?:\.\d+)?", r"\b(\d{4}-\d{2}-\d{2})\b"


def source_problems(docs: DataFrame, constants: DataFrame, days: DataFrame, never: DataFrame, known_files: DataFrame) -> DataFrame:
    """(file, problem, detail): what is wrong with the source of a corpus before it is rendered.

    docs: file, text, declared (ids). constants: kind, id, value, file. days: day, the dates that may be written. never: phrase, what no rendered text may
    have. known_files: file, those that exist besides the documents. Amounts are to be placeholders, dates known, declared ids used and used ones declared,
    unknown ids are named, constants' files exist and have them, and no amount lies within another.
    """
    t = F.coalesce("text", F.lit(""))
    found = lambda df, problem, detail: df.select("file", F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    each = lambda pattern, group: F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(group))))
    written = docs.select("file", each(AMOUNT_WRITTEN, 0).alias("_d"))
    dates = docs.select("file", each(ISO_DATE, 1).alias("_d")).join(days.select(F.col("day").alias("_d")), "_d", "left_anti")
    rendered = render(docs.select(F.col("file").alias("doc_id"), t.alias("text")), constants.select("kind", "id", "value"))
    held = phrases_in(rendered.select("doc_id", "rendered", X.bare(F.col("rendered")).alias("_bare")), ["doc_id", "_bare"], "_bare", never.select(X.bare(F.col("phrase")).alias("phrase")))
    said = held.withColumnRenamed("phrase", "_p").join(never.select("phrase", X.bare(F.col("phrase")).alias("_p")), "_p").where(F.contains("_bare", F.col("_p"))).select("doc_id", "phrase")
    used = docs.select("file", each(PLACEHOLDER, 2).alias("id"))
    declared = docs.select("file", F.explode(F.coalesce("declared", F.array().cast("array<string>"))).alias("id"))
    unknown = rendered.select(F.col("doc_id").alias("file"), F.explode(F.filter(F.split("unknown", ","), lambda x: x != "")).alias("_d"))
    placed = constants.where("file is not null")
    files = docs.select("file").union(known_files.select("file")).distinct()
    here = placed.join(docs.select("file"), "file", "left_semi").where("kind = 'amount'").join(used, ["file", "id"], "left_anti")
    digits = constants.where("kind = 'amount'").select(F.regexp_replace("value", r"[^\d.]", "").alias("digits"))
    inside = substring_collisions(digits).select(F.lit(None).cast("string").alias("file"), F.concat_ws(" in ", "a", "b").alias("_d"))
    parts = [
        found(written, "literal amount", F.col("_d")), found(dates, "unknown date", F.col("_d")), found(said.select(F.col("doc_id").alias("file"), "phrase").distinct(), "never to be written", F.col("phrase")),
        undeclared(used, declared).select("file", "problem", F.col("id").alias("detail")), found(unknown, "unknown constant", F.col("_d")),
        found(docs.where(F.contains(t, F.lit("{{TODO"))), "unfinished", F.lit("")), found(placed.join(files, "file", "left_anti"), "no such file", F.col("id")), found(here, "not placed", F.col("id")), found(inside, "amount within another", F.col("_d")),
    ]
    return reduce(DataFrame.union, parts)


def build_manifest(written: DataFrame, inherited: DataFrame) -> DataFrame:
    """(file, kind, sha256, same) of a corpus that was built: written (file, kind, content), and whether inherited files (file, content) are byte by byte what they were."""
    before = inherited.select("file", F.sha2("content", 256).alias("_before"))
    hashed = written.select("file", "kind", F.sha2("content", 256).alias("sha256")).join(before, "file", "left")
    return hashed.select("file", "kind", "sha256", F.coalesce(F.col("sha256") == F.col("_before"), F.lit(True)).alias("same"))


def structure(chunks: DataFrame, files: DataFrame, skipped: DataFrame) -> DataFrame:
    """(file, check), each once: what of an index contradicts its files.

    chunks: file, n, of, date, overview (null for what is no message). files: file. skipped: file, partial. Messages of a thread are numbered without gaps in
    the order of their dates and have one overview; each file is indexed or named as skipped, and what is partly read is indexed. All rows of a file meet once,
    dealt out by their number, so that one task never makes all checks of all files.
    """
    columns = {"n": "int", "of": "int", "date": "string", "overview": "boolean", "indexed": "boolean", "listed": "boolean", "partial": "boolean"}
    row = lambda df, **given: df.select("file", *(given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))
    every = row(chunks, **{c: F.col(c) for c in ("n", "of", "date", "overview")}, indexed=F.lit(True)).union(row(files, listed=F.lit(True))).union(row(skipped, partial=F.col("partial")))
    mail = F.col("n").isNotNull()
    rows = every.repartition(parts(every, TASK_ROWS), "file").groupBy("file", "n").agg(
        F.min(F.when(mail, F.col("date"))).alias("date"), F.max(F.when(mail, F.col("of"))).alias("of"), F.count_if("overview").alias("views"), F.bool_or("indexed").alias("indexed"), F.bool_or("listed").alias("listed"),
        F.bool_or("partial").alias("partly"), F.bool_or(~F.col("partial")).alias("whole"),
    )
    late = (F.lag("date").over(Window.partitionBy("file").orderBy("n")) > F.col("date")) & (F.col("date") != "")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    found = rows.withColumn("late", late).groupBy("file").agg(F.count("n").alias("n"), F.max("n").alias("last"), F.max("of").alias("of"), F.sum("views").alias("views"), *map(flag, ("late", "indexed", "listed", "partly", "whole")))
    checks = {
        "messages out of order": "late", "numbers with gaps": "n > 0 and (n <> last or of <> last)", "no single overview": "of > 1 and views <> 1", "neither indexed nor skipped": "listed and not indexed and not whole",
        "partly read but not indexed": "partly and not indexed", "skipped but indexed": "whole and indexed",
    }
    return found.select("file", F.explode(F.array_compact(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in checks.items())))).alias("check"))


def haystack(spark: SparkSession, chunks: int, needle: str, depth: float, seed: int = 7) -> DataFrame:
    """(pos, text): filler paragraphs, the same for a seed, with one needle at a relative depth."""
    words = F.array(*map(F.lit, "report review matter filing notice schedule draft response record meeting option period office draft party detail".split()))
    pick = lambda k: F.element_at(words, F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.size(words)).cast("int") + 1)
    text = F.concat_ws(" ", *(pick(k) for k in range(40)))
    at = min(chunks - 1, int(depth * chunks))
    return spark.range(chunks).select(F.col("id").alias("pos"), F.when(F.col("id") == at, needle).otherwise(text).alias("text"))


def hidden_in(filler: DataFrame, needle: str, depth: float) -> DataFrame:
    """The same with given texts (pos, text) as filler: the needle stands in the place of the one at that relative depth."""
    at = filler.agg(F.expr(f"percentile_disc({depth}) WITHIN GROUP (ORDER BY pos)")).scalar()
    return filler.select("pos", F.when(F.col("pos") == at, needle).otherwise(F.col("text")).alias("text"))


BAND, BANNER_SHARE, GAP_SHARE = 320000, 0.6, 12


def slide_order(shapes: DataFrame) -> DataFrame:
    """Adds place, the reading order of a slide's shapes. shapes: slide, shape, x, y, cx, width; x and y are null for shapes without a place.

    Wide shapes are banners and come first. Shapes without a place are taken to stand at the left, below all others. The others fall into columns where the gaps between their left edges are wide; if there
    are several columns, one of them with two shapes, they are read by column, else in bands from top to bottom.
    """
    w = Window.partitionBy("slide")
    banner = F.col("cx") >= BANNER_SHARE * F.col("width")
    s = shapes.withColumn("_x", F.coalesce("x", F.lit(0))).withColumn("_y", F.coalesce("y", F.lit(10**12) + F.col("shape"))).withColumn("_banner", F.coalesce(banner, F.lit(False)))
    by_x = Window.partitionBy("slide", "_banner").orderBy("_x", "shape")
    jump = (F.col("_x") - F.lag("_x").over(by_x) > F.col("width") / GAP_SHARE).cast("int")
    s = s.withColumn("_jump", F.coalesce(jump, F.lit(0)))
    s = s.withColumn("_column", F.sum("_jump").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_in", F.count("*").over(Window.partitionBy("slide", "_banner", "_column")))
    plain = ~F.col("_banner")
    columns = (F.max(F.when(plain, F.col("_column"))).over(w) > 0) & (F.max(F.when(plain, F.col("_in"))).over(w) >= 2)
    s = s.withColumn("_by_column", F.coalesce(columns, F.lit(False)))
    by_column = F.col("_by_column") & ~F.col("_banner")
    down = F.when(F.col("_by_column") | F.col("_banner"), F.col("_y")).otherwise(F.bround(F.col("_y") / BAND))
    key = (F.when(F.col("_banner"), 0).otherwise(1), F.when(by_column, F.col("_column")).otherwise(0), down, F.when(by_column, F.col("shape")).otherwise(F.col("_x")), "shape")
    return s.withColumn("place", F.row_number().over(w.orderBy(*key))).drop("_x", "_y", "_banner", "_jump", "_column", "_in", "_by_column")
