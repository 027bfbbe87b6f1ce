"""Which files are indexed, which are not and why, and what is to be converted. files: file, dir, stem, ext, sha256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats that are read, those a tool converts (tool, format made), images, and those to export by hand.
READ = [".md", ".markdown", ".txt", ".pptx", ".docx", ".eml"]
CONVERTED = {".pdf": ("pdftotext", ".txt"), ".doc": ("textutil", ".docx"), ".rtf": ("textutil", ".docx"), ".html": ("textutil", ".docx"), ".htm": ("textutil", ".docx"), ".ppt": ("soffice", ".pptx")}
IMAGES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".heic"]
BY_HAND = {
    ".msg": "export it from Outlook as .eml", ".pages": "export it from Pages as .docx", ".key": "export it from Keynote as .pptx", ".numbers": "export the sheet as .txt",
    ".xlsx": "export the sheet as .txt", ".csv": "save it as .txt",
}
MIN_TEXT = 20


def hidden(name: Column) -> Column:
    return name.rlike(r"^(\.|~\$)")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def tool_of(ext: Column) -> Column:
    return F.element_at(_map({e: t for e, (t, _) in CONVERTED.items()}), ext)


def made_ext(ext: Column) -> Column:
    return F.element_at(_map({e: m for e, (_, m) in CONVERTED.items()}), ext)


def skip_reason(ext: Column, has_tool: Column, empty: Column) -> Column:
    tool, made = tool_of(ext), made_ext(ext)
    return (
        F.when(tool.isNotNull() & empty, "converted but no text found (scanned image? needs OCR); not indexed")
        .when(tool.isNotNull() & has_tool, F.concat(F.lit("auto-converts to "), made, F.lit(" on ingest ("), tool, F.lit("); run ingest")))
        .when(tool.isNotNull(), F.concat(F.lit("convert by hand: "), tool, F.lit(" is not installed (or save it as "), made, F.lit(")")))
        .when(ext.isin(IMAGES), "image: no local OCR/vision pass yet; not indexed")
        .when(ext.isin(list(BY_HAND)), F.concat(F.lit("convert by hand: "), F.element_at(_map(BY_HAND), ext)))
        .otherwise("unsupported file type")
    )


def classify(files: DataFrame, empty_sources: DataFrame | None = None, tools: list[str] | None = None) -> DataFrame:
    """(file, ext, status, why): indexable, covered (a readable file of the same stem beside it) or skipped with a reason."""
    shown = files.where(~hidden(F.concat("stem", "ext"))).withColumn("_stem", F.lower("stem")).withColumn("ext", F.lower("ext"))
    beside = shown.where(F.col("ext").isin(READ)).select("dir", "_stem").distinct().withColumn("_beside", F.lit(True))
    marked = shown.join(beside, ["dir", "_stem"], "left")
    if empty_sources is not None:
        marked = marked.join(empty_sources.select("file", F.lit(True).alias("_empty")), "file", "left")
    else:
        marked = marked.withColumn("_empty", F.lit(False))
    has_tool = F.coalesce(tool_of(F.col("ext")).isin(tools or []), F.lit(False))
    status = F.when(F.col("ext").isin(READ), "indexable").when(F.col("_beside"), "covered").otherwise("skipped")
    why = F.when(status == "skipped", skip_reason(F.col("ext"), has_tool, F.coalesce("_empty", F.lit(False))))
    return marked.select("file", "ext", status.alias("status"), why.alias("why"))


def diff(indexable: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file, state): new, not indexed yet, or gone, indexed but no longer there."""
    a, b = indexable.select("file").distinct(), indexed.select("file").distinct()
    return a.join(b, "file", "left_anti").select("file", F.lit("new").alias("state")).union(b.join(a, "file", "left_anti").select("file", F.lit("gone").alias("state")))


def report(skipped: DataFrame, names: int = 3) -> DataFrame:
    """(why, n, names): each reason with its count and first names in order; what is gathered for a reason is bounded by a rank."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("why").orderBy("file"))
    few = skipped.withColumn("_k", first).where(F.col("_k") <= names).groupBy("why").agg(F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("names"))
    counts = skipped.groupBy("why").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > names, ", ...").otherwise("")
    return counts.join(few, "why").select("why", "n", F.concat("names", more).alias("names"))


MANIFEST = "sidecar string, source string, hash string, empty boolean"


def convertible(files: DataFrame, manifest: DataFrame, tools: list[str]) -> DataFrame:
    """Files that a tool can convert, with what conversion_decision() asks: files (file, dir, stem, ext, mtime, sha256) meet their sidecars, other companions and the manifest."""
    shown = files.where(~hidden(F.concat("stem", "ext")) & F.col("ext").isin(list(CONVERTED)))
    shown = shown.withColumn("tool", tool_of(F.col("ext"))).withColumn("sidecar", F.concat("dir", "stem", made_ext(F.col("ext"))))
    beside = files.select(F.col("file").alias("sidecar"), F.col("mtime").alias("_m"))
    stem = F.lower("stem")
    others = files.where(F.col("ext").isin(READ)).select("dir", stem.alias("_stem"), F.col("ext").alias("_ext")).groupBy("dir", "_stem").agg(F.collect_set("_ext").alias("_others"))
    rows = shown.withColumn("_stem", stem).join(beside, "sidecar", "left").join(others, ["dir", "_stem"], "left")
    rows = rows.join(manifest.select("sidecar", F.col("source").alias("_source"), F.col("hash").alias("known_hash"), F.coalesce("empty", F.lit(False)).alias("known_empty")), "sidecar", "left")
    time = lambda c: F.unix_millis(F.col(c).cast("timestamp")) / 1000
    other = F.size(F.array_remove(F.coalesce("_others", F.array().cast("array<string>")), made_ext(F.col("ext")))) > 0
    return rows.select(
        "file", "sidecar", "sha256", "tool", time("mtime").alias("mtime"), F.col("_m").isNotNull().alias("sidecar_exists"), time("_m").alias("sidecar_mtime"), F.coalesce(F.col("_source") == F.col("file"), F.lit(False)).alias("ours"),
        F.coalesce("known_hash", F.lit("")).alias("known_hash"), F.coalesce("known_empty", F.lit(False)).alias("known_empty"), other.alias("other_companion"), F.coalesce(F.col("tool").isin(tools), F.lit(False)).alias("has_tool"),
    )


def next_manifest(manifest: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest after conversions (file, sidecar, sha256, event): what was made or found empty replaces its row, and rows whose source is gone go."""
    made = events.where("event in ('converted', 'empty')").select("sidecar", F.col("file").alias("source"), F.col("sha256").alias("hash"), (F.col("event") == "empty").alias("empty"))
    return live_manifest(manifest.join(made, "sidecar", "left_anti").select("sidecar", "source", "hash", "empty").union(made), files).select("sidecar", "source", "hash", "empty")


def warning_lines(skipped: DataFrame) -> DataFrame:
    """(line): how many files can't be seen, and how many only in part, each with its first names. skipped: file, partial."""
    why = F.when(F.col("partial"), "indexed but only PARTIALLY read (footnotes, headers and footers are dropped)").otherwise("NOT indexed and cannot be seen")
    said = report(skipped.select("file", why.alias("why")))
    return said.select(F.concat(F.lit("[coverage] "), F.col("n").cast("string"), F.lit(" file(s) are "), "why", F.lit(": "), "names").alias("line"))


def conversion_decision(rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """Adds decision to convertible files: none, stale, pending or convert.

    rows: sha256, mtime, sidecar_exists, sidecar_mtime, ours (the manifest has this source for the sidecar), known_hash,
    known_empty, other_companion, has_tool. In order: an own sidecar of the same hash is up to date; another's sidecar stays, and is
    stale if its source is newer by over a second; another readable companion covers the file; a scan that is known and
    unchanged stays; without a tool nothing is done.
    """
    c = F.col
    decision = (
        F.when(c("sidecar_exists") & c("ours") & (c("known_hash") == c("sha256")), "none")
        .when(c("sidecar_exists") & ~c("ours"), F.when(c("mtime") > c("sidecar_mtime") + 1, "stale").otherwise("none"))
        .when(~c("sidecar_exists") & c("other_companion"), "none")
        .when(~c("sidecar_exists") & c("ours") & c("known_empty") & (c("known_hash") == c("sha256")), "none")
        .when(~c("has_tool"), "none")
        .otherwise("pending" if dry_run else "convert")
    )
    return rows.withColumn("decision", decision)


def after_conversion(decided: DataFrame) -> DataFrame:
    """Adds event to rows with decision, ok and text: failed, empty or converted for what was run."""
    event = F.when(F.col("decision") != "convert", F.nullif("decision", F.lit("none"))).when(~F.col("ok"), "failed").when(F.length(F.trim(F.coalesce("text", F.lit("")))) < MIN_TEXT, "empty").otherwise("converted")
    return decided.withColumn("event", event)


def live_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest without rows whose source is gone."""
    return manifest.join(files.select(F.col("file").alias("source")), "source", "left_semi")


def folders(indexed: DataFrame, skipped: DataFrame, new: DataFrame) -> DataFrame:
    """(folder, indexed, skipped, new): an inventory by top folder."""
    top = F.when(F.instr("file", "/") > 0, F.split_part("file", F.lit("/"), F.lit(1))).otherwise("(root)")
    rows = [d.select(top.alias("folder"), F.lit(k).alias("_k")) for k, d in (("indexed", indexed), ("skipped", skipped), ("new", new))]
    every = rows[0].union(rows[1]).union(rows[2])
    return every.groupBy("folder").agg(*(F.count_if(F.col("_k") == k).alias(k) for k in ("indexed", "skipped", "new")))
