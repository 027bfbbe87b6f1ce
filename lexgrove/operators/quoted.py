"""Quoted mail chains as row patterns: lines are classed, runs of header lines become heads by windows, and what lies between heads is a message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import keep
from ..sources.mail import HEADER_KEYS, HEADER_LINES, OPENERS, PARTING, TIME_WORDS, VERBS, clean_party
from .segment import reached

_QUOTED = r"^(?U)(?:\s*>)+\s?"
_FIELD = rf"^(?iU)\s*\*{{0,2}}({'|'.join(HEADER_KEYS)})\*{{0,2}}\s*[:：](.*)$"
_RULE = rf"^(?iU)\s*(?:-{{3,}}\s*(?:{'|'.join(PARTING)})\s*-{{3,}}|begin forwarded message:|[-_]{{10,}})\s*$"
_INTRO = rf"^(?iU)(?:(?:{'|'.join(OPENERS)})\s+(.+?)[\s,]*(?:{'|'.join(VERBS)})\s*:|(.+?)\s*님이\s*작성\s*:)$"
_AT = r"<?([\w.+%-]+@[\w-]+(?:\.[\w-]+)+)>?"


@F.pandas_udf(StringType())
def _clean(party: pd.Series) -> pd.Series:
    """Parties of header lines as 'Name <address>'."""
    return party.map(lambda x: None if x is None else clean_party(x))


def introduced(middle: Column) -> Column:
    """The party that an introducing line names behind its date: '' if none; null if the line has neither an address nor a figure."""
    address = F.regexp_extract(middle, _AT, 1)
    before = F.when(address == "", middle).otherwise(F.split(middle, _AT, 2)[0])
    words = F.filter(F.split(before, r"(?U)\s+"), lambda w: w != "")
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    last = lambda ok: F.array_max(F.transform(F.filter(indexed, lambda x: ok(x["w"])), lambda x: x["i"]))
    dated = last(lambda w: w.rlike(r"\d") | F.btrim(F.lower(w), F.lit(",.()")).isin(sorted(TIME_WORDS)))
    at = F.coalesce(dated, last(lambda w: w.endswith(",")), F.lit(-1))
    name = F.btrim(F.array_join(F.slice(words, at + 2, F.greatest(F.size(words), F.lit(1))), " "), F.lit(" ,'\""))
    party = F.when(address == "", name).when(name == "", address).otherwise(F.concat(name, F.lit(" <"), address, F.lit(">")))
    return F.when((middle == "") | ((address == "") & ~middle.rlike(r"\d")), None).otherwise(party)


def classed(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) -> with line unquoted, and kind: rule parts messages, field is a header line (header, value), fold may go on with one, text is the rest."""
    line = F.regexp_replace(F.regexp_replace("line", r"\r+$", ""), _QUOTED, "")
    rows = lines.withColumn("line", line)
    header = F.lower(F.regexp_extract("line", _FIELD, 1))
    keys = F.create_map(*(F.lit(x) for kv in HEADER_KEYS.items() for x in kv))
    kind = F.when(F.col("line").rlike(_RULE), "rule").when(header != "", "field").when(F.col("line").rlike(r"^[ \t]") & (F.trim(F.regexp_replace("line", r"(?U)\s+", "")) != ""), "fold").otherwise("text")
    return rows.withColumn("kind", kind).withColumn("header", F.when(F.col("kind") == "field", F.try_element_at(keys, header))).withColumn("value", F.when(F.col("kind") == "field", F.trim(F.regexp_extract("line", _FIELD, 2))))


def _blocks(rows: DataFrame) -> DataFrame:
    """Heads of header lines: of each run of header lines a part begins at every sender; it is a head if it has a date, and a recipient or subject, within HEADER_LINES."""
    w = Window.partitionBy("file").orderBy("line_no")
    inside = F.col("kind").isin("field", "fold")
    sender = F.coalesce(F.col("header") == "from", F.lit(False))
    begins = sender | ~inside
    parts = rows.withColumn("_part", F.sum(begins.cast("int")).over(w)).where(inside)
    in_part = Window.partitionBy("file", "_part").orderBy("line_no")
    parts = parts.withColumn("_n", F.row_number().over(in_part)).withColumn("_first", F.first("header").over(in_part)).where((F.col("_first") == "from") & (F.col("_n") <= HEADER_LINES))
    of = lambda h: F.max_by("value", F.when(F.col("header") == h, F.col("line_no"))).alias(h)
    heads = parts.groupBy("file", "_part").agg(F.min("line_no").alias("first"), (F.max("line_no") + 1).alias("after"), *(of(h) for h in ("from", "to", "cc", "subject", "date")))
    heads = heads.where("date is not null and (`to` is not null or subject is not null)")
    return heads.select("file", "first", "after", *(_clean(F.coalesce(c, F.lit(""))).alias(c) for c in ("from", "to", "cc")), F.coalesce("subject", F.lit("")).alias("subject"), "date")


def _introductions(rows: DataFrame) -> DataFrame:
    """Heads of one introducing line, or of one that goes on in the next."""
    w = Window.partitionBy("file").orderBy("line_no")
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")
    here = rows.withColumn("_one", flat(F.col("line"))).withColumn("_two", F.concat_ws(" ", "_one", F.lead("_one").over(w)))
    middle = lambda c: F.concat(F.regexp_extract(c, _INTRO, 1), F.regexp_extract(c, _INTRO, 2))
    found = here.withColumn("_m1", middle("_one")).withColumn("_m2", middle("_two")).where("_m1 <> '' or _m2 <> ''")
    found = found.withColumn("_p1", introduced(F.col("_m1"))).withColumn("_p2", introduced(F.col("_m2"))).where("_p1 is not null or _p2 is not null")
    one = F.col("_p1").isNotNull()
    none = F.lit("")
    return found.select(
        "file", F.col("line_no").alias("first"), (F.col("line_no") + F.when(one, 1).otherwise(2)).alias("after"), F.coalesce("_p1", "_p2").alias("from"), none.alias("to"), none.alias("cc"), none.alias("subject"), F.when(one, F.col("_m1")).otherwise(F.col("_m2")).alias("date")
    )


def split(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) of mail bodies -> messages (file, pos, from, to, cc, subject, date_raw, text), in the file's order: its own text first, then each quoted one.

    Quote marks go, and so do lines that part messages and blank ones at a message's ends. Of heads that overlap the first one counts. All is done on
    ordered lines by windows of bounded width and running sums; a file's heads that count are found by pointers (segment.reached), so no file is one row.
    """
    rows = keep(classed(lines), "lines")  # heads of both kinds and the texts are made from them
    heads = _blocks(rows).withColumn("_late", F.lit(0)).union(_introductions(rows).withColumn("_late", F.lit(1)))
    once = F.row_number().over(Window.partitionBy("file", "first").orderBy("_late"))
    heads = heads.withColumn("_k", once).where("_k = 1").drop("_k", "_late")
    w = Window.partitionBy("file").orderBy("first")
    following = F.collect_list("first").over(w.rowsBetween(1, HEADER_LINES))  # a head has no more lines than that
    heads = heads.withColumn("k", F.col("first")).withColumn("begins", F.row_number().over(w) == 1).withColumn("next", F.array_min(F.filter(following, lambda x: x >= F.col("after"))))
    heads = keep(heads, "heads")
    kept = heads.join(reached(heads.select("file", "k", "begins", "next")), ["file", "k"], "left_semi").drop("k", "begins", "next")
    marked = rows.join(kept.withColumn("line_no", F.col("first")).withColumn("_head", F.lit(1)), ["file", "line_no"], "left")
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("pos", F.count("_head").over(so_far).cast("int")).withColumn("_after", F.last("after", ignorenulls=True).over(so_far))
    body = placed.where(F.col("_after").isNull() | (F.col("line_no") >= F.col("_after"))).where("kind <> 'rule'")
    full = body.withColumn("_full", F.when(F.regexp_replace("line", r"(?U)\s+", "") != "", F.col("line_no")))
    ends = Window.partitionBy("file", "pos")
    inside = full.withColumn("_a", F.min("_full").over(ends)).withColumn("_b", F.max("_full").over(ends)).where(F.col("line_no").between(F.col("_a"), F.col("_b")))
    texts = inside.groupBy("file", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    own = rows.select("file").distinct().select("file", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("from", "to", "cc", "subject", "date_raw")))
    numbered = kept.withColumn("pos", F.row_number().over(w)).select("file", "pos", "from", "to", "cc", "subject", F.col("date").alias("date_raw"))
    return own.union(numbered).join(texts, ["file", "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
