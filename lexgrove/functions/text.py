"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The stop list of the tokenizer.
STOP = "the a an of to in for and or is are was were be on at as by with that this it from".split()
TOKEN = r"[a-z0-9]+(?:[._\-][a-z0-9]+)*"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"


def stem(t: Column) -> Column:
    """Drops a final s of words longer than three letters that don't end in ss."""
    return F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t)


def terms(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(*keys, term), a row for each token of each row's text. Stop words go before stemming; a compound gives itself and its parts that are no stop words.

    Tokens are rows, not arrays, so that all that is done to each of them runs in generated code.
    """
    words = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("_t")).where(~F.col("_t").isin(STOP))
    compound = F.translate("_t", "._-", "") != F.col("_t")
    parts = F.posexplode(F.when(compound, F.concat(F.array("_t"), F.split("_t", r"[._\-]+"))).otherwise(F.array("_t"))).alias("_k", "_t")
    every = words.select(*keys, parts).where((F.col("_k") == 0) | ~F.col("_t").isin(["", *STOP]))
    return every.select(*keys, stem(F.col("_t")).alias("term"))


def chunk_text(text: Column, heading: Column, file: Column) -> Column:
    """What of a chunk is searched: text, heading, and the path with its separators as spaces."""
    return F.concat_ws(" ", text, heading, F.translate(file, "/_.-", "    "))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def bare(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(""))


def in_scope(file: Column, scope: Column) -> Column:
    """Equal to the scope, or below it; a trailing slash of the scope doesn't matter, an empty or null scope holds all."""
    s = F.regexp_replace(F.coalesce(scope, F.lit("")), "/+$", "")
    return (s == "") | (file == s) | F.startswith(file, F.concat(s, F.lit("/")))


def source_key(file: Column, heading: Column) -> Column:
    """Bucket for diversity: the top folder, or for files without a folder the file and heading."""
    return F.when(F.instr(file, "/") > 0, F.split_part(file, F.lit("/"), F.lit(1))).otherwise(F.concat(file, F.lit(" > "), F.coalesce(heading, F.lit(""))))


# What a model says when it refuses.
REFUSALS = ["not in the documents", "not specified in the sources"]


def normalise(text: Column) -> Column:
    """Lower case, straight quotes, no-break spaces as spaces, white space collapsed."""
    straight = F.translate(F.lower(text), "‘’“” ", "''\"\" ")
    return F.trim(F.regexp_replace(straight, r"\s+", " "))


def is_refusal(answer: Column) -> Column:
    """Whether a refusal leads or ends the answer; emphasis marks, citation labels and a final stop don't matter."""
    flat = F.regexp_replace(F.translate(F.lower(F.trim(answer)), "*_", ""), r"\[s\d+\]", "")
    flat = F.regexp_replace(F.regexp_replace(flat, r"^\s+", ""), r"[\s.]+$", "")
    return F.coalesce(F.greatest(*(F.startswith(flat, F.lit(p)) | F.endswith(flat, F.lit(p)) for p in REFUSALS)), F.lit(False))


def looks_stuck(text: Column, tail: int = 300, window: int = 3600, times: int = 3) -> Column:
    """Whether the last `tail` characters occur `times` times in the last `window`."""
    end, recent = F.right(text, F.lit(tail)), F.right(text, F.lit(window))
    return (F.length(text) >= tail) & ((F.length(recent) - F.length(F.replace(recent, end, F.lit("")))) / tail >= times)


# Elements that go with all they hold, and tags that stand for the end of a line.
HTML_DROPPED = r"(?is)<(script|style|head).*?</\1>"
HTML_ENDS = r"(?i)<br\s*/?>|</p>|</div>|</tr>|</li>|</h\d>|</blockquote>|</table>"
HTML_BEGINS = r"(?i)<p[^>]*>|<div[^>]*>|<blockquote[^>]*>"
#: What is done to markup before character references are read, and after it: pattern, replacement.
BEFORE_REFERENCES = [(HTML_DROPPED, ""), (HTML_ENDS, "\n"), (HTML_BEGINS, "\n"), (r"<[^>]+>", "")]
AFTER_REFERENCES = [("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]


#: A character reference as HTML 5 reads it, whole or by a prefix of its name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _characters(references: pd.Series) -> pd.Series:
    return references.map(lambda x: None if x is None else [html.unescape(r) for r in x])


def unescape(text: Column) -> Column:
    """Character references of HTML 5 as characters, each read once. Spark has no function for its 2,231 names and their prefixes: Python gets the references, never the texts."""
    read = _characters(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    pieces = F.transform(F.arrays_zip(F.split(text, REFERENCE).alias("piece"), read.alias("read")), lambda x: F.concat(x["piece"], F.coalesce(x["read"], F.lit(""))))
    return F.array_join(pieces, "")


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_html(markup: Column) -> Column:
    """Markup to lines: scripts, styles and the head go, block tags are line ends, other tags go, references are characters, blanks before a line end go."""
    return _replaced(unescape(_replaced(markup, BEFORE_REFERENCES)), AFTER_REFERENCES)


def html_stripped(rows: DataFrame, column: str) -> DataFrame:
    """The same for a column of rows. Tags go in a step of its own, once, as references and what is between them are both taken from what is left."""
    plain = rows.withColumn(column, _replaced(F.col(column), BEFORE_REFERENCES))
    return plain.withColumn(column, _replaced(unescape(F.col(column)), AFTER_REFERENCES))


def stripped(markup: str) -> str:
    """The same for one text, for what is parsed within a task."""
    for pattern, new in BEFORE_REFERENCES:
        markup = re.sub(pattern, new, markup)
    text = html.unescape(markup)
    for pattern, new in AFTER_REFERENCES:
        text = re.sub(pattern, new, text)
    return text


def estimate_tokens(characters: Column) -> Column:
    return F.floor(characters / 4)


# Prefixes of replies and forwards in several languages.
REPLY, FORWARD = ["re", "aw", "sv", "답장"], ["fw", "fwd", "wg", "tr", "전달"]


def base_subject(subject: Column) -> Column:
    words = "|".join(REPLY + FORWARD)
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), rf"(?i)^\s*(?:(?:{words})\s*:\s*)+", ""))


def subject_verb(subject: Column, inherited: Column, first: Column) -> Column:
    s = F.coalesce(subject, F.lit(""))
    return (
        F.when(inherited, F.when(first, "wrote").otherwise("replied"))
        .when(s.rlike(rf"(?i)^\s*(?:{'|'.join(REPLY)})\s*:"), "replied")
        .when(s.rlike(rf"(?i)^\s*(?:{'|'.join(FORWARD)})\s*:"), "forwarded")
        .otherwise("wrote")
    )


def display_name(party: Column) -> Column:
    """The name before <address>; without one, the party as it is."""
    name = F.regexp_extract(party, r'^\s*"?([^<"]+?)"?\s*<', 1)
    return F.when(name != "", F.trim(name)).otherwise(F.trim(F.coalesce(party, F.lit(""))))


def note_slug(question: Column, words: int = 6) -> Column:
    """The first words of a question, joined for a file name."""
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.nullif(F.array_join(F.slice(found, 1, words), "-"), F.lit("")), F.lit("note"))


def machine_slug(name: Column) -> Column:
    """A name that is safe in a file name."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))
