"""From text to chunks: sections, lines, headings carried forward, chunks at headings, blank lines and table edges, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

MERGE_CHARS = 900


def sections(docs: DataFrame) -> DataFrame:
    """(file, section, base, text): a part for each form feed, with the heading 'page N' if there are several."""
    parts = docs.select("file", F.posexplode(F.split("text", "\f")).alias("section", "text"), F.size(F.split("text", "\f")).alias("_n"))
    base = F.when(F.col("_n") > 1, F.concat(F.lit("page "), (F.col("section") + 1).cast("string"))).otherwise("")
    return parts.select("file", "section", base.alias("base"), "text")


def lines(parts: DataFrame) -> DataFrame:
    """(file, section, base, line_no, line)."""
    return parts.select("file", "section", "base", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def forward_headings(rows: DataFrame) -> DataFrame:
    """Adds is_heading, heading and title to lines: the last heading above a line, and the last top one over deeper ones.

    A heading with an arrow, as those of messages, carries no title; a base heading goes before each.
    """
    w = Window.partitionBy("file", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").rlike("^#{1,6} ")
    own = F.trim(F.regexp_replace("line", "^#+", ""))
    top_level = F.col("line").rlike("^# ")
    marked = rows.withColumn("is_heading", is_heading).withColumn("_h", F.when(F.col("is_heading"), own))
    marked = marked.withColumn("_top", F.last(F.when(top_level, F.col("_h")), ignorenulls=True).over(w))
    title = F.when(F.col("is_heading"), F.when(top_level | F.col("_top").isNull() | F.contains(F.col("_h"), F.lit("->")), "").otherwise(F.col("_top")))
    carried = marked.withColumn("_h", F.last("_h", ignorenulls=True).over(w)).withColumn("_t", title)
    base = F.col("base")
    heading = F.when(F.col("_h").isNull(), base).when(base == "", F.col("_h")).otherwise(F.concat_ws(" / ", base, F.col("_h")))
    return carried.withColumn("heading", heading).withColumn("title", F.coalesce(F.last("_t", ignorenulls=True).over(w), F.lit(""))).drop("_h", "_top", "_t")


def raw_chunks(rows: DataFrame) -> DataFrame:
    """(file, section, first_line, heading, title, text): chunks begin at headings, at blank lines outside tables and at the edges of tables.

    Gap and island: each begin raises a running count; a heading or blank line is in no chunk.
    """
    w = Window.partitionBy("file", "section").orderBy("line_no")
    table = F.ltrim("line").startswith("|")
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    edge = F.coalesce(F.lag("_table").over(w), F.lit(False)) != F.col("_table")
    cut = rows.withColumn("_table", table & ~F.col("is_heading")).withColumn("_blank", blank)
    cut = cut.withColumn("_begin", (F.col("is_heading") | F.col("_blank") | edge).cast("int"))
    cut = cut.withColumn("_island", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not is_heading and not _blank")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = cut.groupBy("file", "section", "_island").agg(F.min("line_no").alias("first_line"), F.first("heading").alias("heading"), F.first("title").alias("title"), text.alias("text"))
    return grouped.select("file", "section", "first_line", "heading", "title", F.regexp_replace(F.regexp_replace("text", r"^\s+", ""), r"\s+$", "").alias("text"))


def _followers(raw: DataFrame, most: int) -> DataFrame:
    """raw with k (place in the file), run (stretch in which neighbours may join), begins (first of its run) and next: the first one of the run that a chunk begun here can't take any more, null if it takes all.

    A chunk that takes i to j has the characters of their texts and two between each. With before, what the run's earlier texts and their two have,
    j doesn't fit where the sum from i to j is most + 4 at least; so the fitting ones are counted by a range of before, which holds most / 3 rows or fewer.
    """
    w = Window.partitionBy("file").orderBy("section", "first_line")
    table = F.ltrim("text").startswith("|")
    apart = F.lag("file").over(w).isNull() | ~F.lag("heading").over(w).eqNullSafe(F.col("heading")) | ~F.lag("title").over(w).eqNullSafe(F.col("title")) | table | F.coalesce(F.lag(table).over(w), F.lit(False))
    rows = raw.withColumn("k", F.row_number().over(w)).withColumn("begins", apart).withColumn("run", F.sum(F.col("begins").cast("int")).over(w))
    run = Window.partitionBy("file", "run")
    size = (F.length("text") + 2).cast("long")
    rows = rows.withColumn("_size", size).withColumn("_before", F.coalesce(F.sum("_size").over(run.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_all", F.sum("_size").over(run)).withColumn("_end", F.max("k").over(run))
    rows = rows.withColumn("_past", F.col("k") + F.count("*").over(run.orderBy("_before").rangeBetween(0, most + 3)))
    follows = F.when((F.col("_past") <= F.col("_end")) | (F.col("_all") >= F.col("_before") + most + 4), F.greatest(F.col("k") + 1, F.col("_past") - 1))
    return rows.withColumn("next", F.when(follows <= F.col("_end"), follows).cast("int")).drop("_size", "_before", "_all", "_end", "_past")


def reached(rows: DataFrame) -> DataFrame:
    """(file, k, begins, next) -> (file, k) of what begins, and of all that it leads to over next: pointers double in each round, so that the rounds are the logarithm of the most chunks of a run."""
    jumps = rows.where("next is not null").select("file", "k", "next")
    at = rows.where("begins and next is not null").select("file", "k")
    found = [rows.where("begins").select("file", "k")]
    while not jumps.isEmpty():
        new = at.join(jumps, ["file", "k"]).select("file", F.col("next").alias("k"), F.lit(None).cast("int").alias("next"))
        far = jumps.join(jumps.select("file", F.col("k").alias("next"), F.col("next").alias("_far")), ["file", "next"]).select("file", "k", F.col("_far").alias("next"))
        both = keep(new.union(far), "jumps")
        found.append(both.where("next is null").select("file", "k"))
        at, jumps = at.union(found[-1]), both.where("next is not null")
    return reduce(DataFrame.union, found)


def merge(raw: DataFrame, most: int = MERGE_CHARS) -> DataFrame:
    """(file, chunk_pos, chunk_id, heading, title, text): small neighbours with equal heading and title become one.

    What comes next joins a chunk while their lengths sum to under `most` and neither is a table. Where a chunk begun at a place would end is
    known for each place (_followers), so the chunks are the places that pointers lead to: no file is folded in one row, and a file of any length costs
    its length times the logarithm of its chunks.
    """
    rows = keep(_followers(raw, most), "followers")
    starts = reached(rows).withColumn("_start", F.lit(1))
    w = Window.partitionBy("file").orderBy("k")
    placed = rows.select("file", "k", "heading", "title", "text").join(starts, ["file", "k"], "left").withColumn("chunk_pos", (F.count("_start").over(w) - 1).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n")
    out = placed.groupBy("file", "chunk_pos").agg(F.any_value("heading").alias("heading"), F.any_value("title").alias("title"), text.alias("text"))
    return out.select("file", "chunk_pos", F.concat_ws("#", "file", F.col("chunk_pos").cast("string")).alias("chunk_id"), "heading", "title", "text")


def chunk(docs: DataFrame) -> DataFrame:
    """(file, text) -> chunks."""
    return merge(raw_chunks(forward_headings(lines(sections(docs)))))


def page_lines(pages: DataFrame) -> DataFrame:
    """pages -> (file, text): markup to lines, with headings as '#' lines and a blank line after each block."""
    from ..functions.text import html_stripped

    html = F.regexp_replace("html", r"(?i)<h([1-6])[^>]*>", "\n# ")
    html = F.regexp_replace(html, r"(?i)</(p|h[1-6]|nav|div|footer)>", "</p>\n")
    return html_stripped(pages.select(F.col("page_id").cast("string").alias("file"), html.alias("text")), "text").withColumn("text", F.trim("text"))
