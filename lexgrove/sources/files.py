"""Document folders, question files and audit files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.coverage import hidden


def walk(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(file, dir, stem, ext, bytes, mtime, sha256[, content]) of all files that are not hidden. Hashes are made where files are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.regexp_replace("path", r"^(?:\w+:)?/*", "")
    base = folder.split("://", 1)[-1].strip("/") + "/"
    rel = F.when(F.instr(rel, base) > 0, F.substring(rel, F.instr(rel, base) + len(base), F.length(rel))).otherwise(rel)
    name = F.element_at(F.split("file", "/"), -1)
    ext = F.regexp_extract("_name", r"(?<=.)\.[^.]+$", 0)
    out = raw.withColumn("file", rel).withColumn("_name", name).where(~hidden(F.col("_name")))
    out = out.withColumn("ext", F.lower(ext)).withColumn("stem", F.left("_name", F.length("_name") - F.length(ext)))
    out = out.withColumn("dir", F.left("file", F.length("file") - F.length("_name"))).withColumn("sha256", F.sha2("content", 256))
    columns = ["file", "dir", "stem", "ext", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "sha256"]
    return out.select(*columns, *(["content"] if content else []))


def texts(files: DataFrame) -> DataFrame:
    """(file, text) of plain text files, what is no UTF-8 replaced."""
    return files.where(F.col("ext").isin(".md", ".markdown", ".txt")).select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, scope, top_k, diverse, question, error) of a question file: blank lines and # comments go; '[flags] :: question'. qid is the line's number, of a second file 2^32 above, and so on."""
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    place = F.dense_rank().over(Window.orderBy("_file")) - 1  # a few files at most
    lines = files.withColumn("_place", place).select("_place", F.posexplode(F.split("value", r"\r?\n")).alias("_line", "value"))
    lines = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return parse_questions(lines.select((F.col("_place") * (1 << 32) + F.col("_line") + 1).cast("long").alias("qid"), "value"))


def parse_questions(lines: DataFrame) -> DataFrame:
    """The override parser over (qid, value)."""
    has = F.contains("value", F.lit("::"))
    flags = F.when(has, F.trim(F.get(F.split("value", "::", 2), F.lit(0)))).otherwise("")
    question = F.trim(F.when(has, F.get(F.split("value", "::", 2), F.lit(1))).otherwise(F.col("value")))
    known = r"^(?:\s*(?:--only\s+\S+|--top-k\s+\d+|--diverse)\s*)*$"
    return lines.select(
        "qid",
        F.nullif(F.regexp_extract(flags, r"--only\s+(\S+)", 1), F.lit("")).alias("scope"),
        F.regexp_extract(flags, r"--top-k\s+(\d+)", 1).try_cast("int").alias("top_k"),
        flags.rlike(r"--diverse\b").alias("diverse"),
        question.alias("question"),
        F.when(~flags.rlike(known), F.concat(F.lit("unknown flags: "), flags)).alias("error"),
    )


def audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Audit records; malformed lines are dropped, missing fields are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
