"""Scoring of answers against keys, and what is made of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text as X
from .phrases import phrases_in

# What says that something is not there, and what excludes a neighbour in a sentence.
REFUSAL_PATTERNS = [
    "not in the documents", "not specified in the sources", "not specified in the source", "no information", "does not specify", "do not specify",
    "is not mentioned", "not mentioned", "no mention", "not stated", "not addressed", "not discussed", "not found", "nothing about", "does not mention",
    "do not mention", "did not write", "did not reply", "did not send", "no message from", "no reply from", "not contain", "does not include", "no record",
]
EXCLUDING = r"(?i)\b(not|no|never|neither|nor|only|rather than|instead of|separate|distinct|different|unaffiliated|excluding|excluded|except|but)\b|\bn't\b"
# More of what counts as a refusal where answers are judged three ways.
NEGATIONS = [
    "unable to refer", "no referral", "did not name", "not quoted", "does not publish", "no flat", "indicative", "not a quote", "no figure", "did not quote", "only says per application",
    "does not say", "not specified", "which firm", "cannot tell", "not clear", "no previous", "ambiguous", "on its own", "no such", "no decision", "not selected", "nobody", "still open",
]
#: Rules that are broadcast, at most.
BROADCAST_RULES = 100_000
SENTENCE_END = r"(?<=[.!?\n])\s+|\n"
AMOUNT = r"(?i)(?:[$€]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s*(?:dollars?|usd|eur|euros?)\b|\b\d{1,3}(?:,\d{3})+\b)"


def refuses(answer: Column) -> Column:
    flat = X.normalise(answer)
    return F.coalesce(F.greatest(*(F.contains(flat, F.lit(p)) for p in REFUSAL_PATTERNS)), F.lit(False))


def variants(token: Column) -> Column:
    """Spellings of a token: money and percents with and without sign and commas; a month's day in several orders."""
    t = X.normalise(token)
    plain = F.regexp_replace(t, r"^\$", "")
    money = F.array(t, plain, X.bare(plain), F.concat(F.lit("$"), X.bare(plain)))
    month, day = F.regexp_extract(t, r"^([a-z]+) (\d{1,2})$", 1), F.regexp_extract(t, r"^([a-z]+) (\d{1,2})$", 2)
    dates = F.array(t, F.concat_ws(" ", day, month), *(F.concat(month, F.lit(" "), day, F.lit(e)) for e in ("th", "st", "nd", "rd")))
    return F.array_distinct(F.when(t.rlike(r"^\$?[\d,]+(?:\.\d+)?%?$"), money).when(month != "", dates).otherwise(F.array(t)))


def present(token: Column, answer: Column) -> Column:
    """Whether a normalised answer has a token; a bare integer must stand alone."""
    t = X.normalise(token)
    alone = F.regexp_count(answer, F.concat(F.lit(r"(?<![\d,.$])"), t, F.lit(r"(?![\d,])"))) > 0
    return F.when(t.rlike(r"^\d+$"), alone).otherwise(F.exists(variants(token), lambda v: F.contains(answer, v)))


def all_present(tokens: Column, answer: Column) -> Column:
    return F.forall(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: present(t, answer))


def any_present(tokens: Column, answer: Column) -> Column:
    return F.exists(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: present(t, answer))


def passes(items: DataFrame) -> DataFrame:
    """Adds passed to rows with type, answer, refused, must, any, must_not, facts, min_facts: the two-way score.

    A refuse item passes if it refuses, or denies without a forbidden token; a summary by its number of facts; others by
    all required tokens. A hedged answer that has what is required passes.
    """
    a = X.normalise(F.col("answer"))
    refused = F.coalesce("refused", F.lit(False)) | refuses(F.col("answer"))
    bad = any_present(F.col("must_not"), a)
    none = F.array().cast("array<array<string>>")
    hits = F.size(F.filter(F.coalesce("facts", none), lambda g: any_present(g, a)))
    need = F.coalesce(F.col("min_facts"), F.greatest(F.lit(1), F.floor(F.size(F.coalesce("facts", none)) / 2)))
    complete = all_present(F.col("must"), a) & F.forall(F.coalesce("any", none), lambda g: any_present(g, a))
    required = (F.size(F.coalesce("must", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("any", none)) > 0)
    passed = (
        F.when(F.col("type") == "refuse", (refused | F.contains(a, F.lit("not"))) & ~bad)
        .when(F.col("type") == "summary", (hits >= need) & ~bad & ~(refused & (hits == 0)))
        .otherwise(complete & ~bad & ~(refused & ~required))
    )
    return items.withColumn("passed", F.coalesce(passed, F.lit(False)))


def scoped(answer: Column) -> Column:
    """The sentences that exclude nothing: what a check of the whole answer reads."""
    sentences = F.filter(F.split(answer, SENTENCE_END), lambda s: (F.trim(s) != "") & ~s.rlike(EXCLUDING))
    return F.array_join(sentences, " ")


def amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))


def three_way(items: DataFrame) -> DataFrame:
    """Adds label: WRONG if a forbidden token or a forged label is there, else CORRECT if what is required is, else SILENT.

    items: answer (null: no record), refused, must, any, must_not, n_sources, labels.
    """
    a, s = X.normalise(F.col("answer")), X.normalise(scoped(F.col("answer")))
    refused = F.coalesce("refused", F.lit(False)) | refuses(F.col("answer"))
    wrong = F.col("answer").isNull() | any_present(F.col("must_not"), s) | F.exists("labels", lambda x: (x < 1) | (x > F.col("n_sources")))
    complete = all_present(F.col("must"), a) & F.forall(F.coalesce("any", F.array().cast("array<array<string>>")), lambda g: any_present(g, a))
    right = F.when(F.col("type") == "refuse", refused | complete).otherwise(complete)
    return items.withColumn("label", F.when(wrong, "WRONG").when(right, "CORRECT").otherwise("SILENT"))


def mentions(texts: DataFrame, key: list[str], text: str, parties: DataFrame) -> DataFrame:
    """(*key, party), each once: parties that a text names by an alias, not as part of a longer word, and not within a name that is another's.

    parties: party, aliases, not_aliases. All aliases are looked for in one pass over the texts.
    """
    alias = parties.select("party", "not_aliases", F.explode(F.array_distinct("aliases")).alias("_alias")).where("_alias rlike '[A-Za-z0-9]'")
    rows = texts.select(*key, F.col(text).alias("_text"))
    met = phrases_in(rows, [*key, "_text"], "_text", alias.select(F.col("_alias").alias("phrase"))).withColumnRenamed("phrase", "_alias").join(alias, "_alias")
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    blank = F.aggregate(F.coalesce("not_aliases", F.array().cast("array<string>")), F.col("_text"), lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?i)"), quoted(n)), F.lit(" ")))
    return met.where(F.regexp_like(blank, F.concat(F.lit("(?i)(?<![A-Za-z])"), quoted(F.col("_alias")), F.lit("(?![A-Za-z])")))).select(*key, "party").distinct()


def sentences(answers: DataFrame) -> DataFrame:
    """(qid, k, sentence) of answers (qid, answer)."""
    return answers.select("qid", F.posexplode(F.split("answer", SENTENCE_END)).alias("k", "sentence")).where("trim(sentence) <> ''")


def attributed(answers: DataFrame, parties: DataFrame) -> DataFrame:
    """(qid, scope): what an answer says of its question's parties: its sentences that exclude nothing, without those that name others only.

    Where a question names no party, all sentences that exclude nothing count. answers: qid, question, answer.
    """
    subject = mentions(answers, ["qid"], "question", parties)
    said = sentences(answers).where(~F.col("sentence").rlike(EXCLUDING))
    named = mentions(said, ["qid", "k"], "sentence", parties).join(subject.withColumn("_own", F.lit(True)), ["qid", "party"], "left")
    others = named.groupBy("qid", "k").agg(F.coalesce(F.bool_or("_own"), F.lit(False)).alias("_own")).where("not _own")
    foreign = others.join(subject.select("qid").distinct(), "qid", "left_semi").select("qid", "k")
    kept = said.join(foreign, ["qid", "k"], "left_anti").groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]), " ").alias("scope"))
    return answers.select("qid").join(kept, "qid", "left").select("qid", F.coalesce("scope", F.lit("")).alias("scope"))


def _figures(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, amount, number): amounts of a text, and their digits."""
    number = F.regexp_replace(F.regexp_replace("amount", r"[^\d.]", ""), r"\.+$", "")
    return rows.select(*key, F.explode(amounts(F.col(text))).alias("amount")).withColumn("number", number).where("number <> ''")


def _labels(text: Column) -> Column:
    bodies = F.regexp_extract_all(text, F.lit(r"\[S([\d,\sS]+)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("int"))


def misplaced(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, k, amount): amounts of a sentence that none of the sources it cites has. sources: qid, label, file, text."""
    cited = sentences(answers).withColumn("_label", F.explode(F.array_distinct(_labels(F.col("sentence"))))).join(sources.select("qid", F.col("label").alias("_label"), X.bare(F.col("text")).alias("_t")), ["qid", "_label"])
    held = _figures(cited, ["qid", "k", "_label", "_t"], "sentence").groupBy("qid", "k", "amount").agg(F.bool_or(F.contains("_t", F.col("number"))).alias("_held"))
    return held.where("not _held").select("qid", "k", "amount")


def banned_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, amount, fragment): amounts whose sources all are files of a fragment that must not be cited. items: qid, answer, cite_must_not."""
    asked = items.select("qid", "answer", F.explode("cite_must_not").alias("fragment"))
    held = _figures(asked, ["qid", "fragment"], "answer").distinct().join(sources.select("qid", "file", X.bare(F.col("text")).alias("_t")), "qid").where(F.contains("_t", F.col("number")))
    return held.groupBy("qid", "amount", "fragment").agg(F.every(F.contains("file", F.col("fragment"))).alias("_all")).where("_all").select("qid", "amount", "fragment")


def made_up(answers: DataFrame, numbers: DataFrame) -> DataFrame:
    """(qid, amount): amounts of three digits and more, in sentences not marked as inferences, that the corpus (number) has nowhere."""
    said = sentences(answers).where(~F.contains(F.upper("sentence"), F.lit("[INFERENCE]")))
    found = _figures(said, ["qid"], "sentence").where(F.col("number").rlike(r"^\d{3,}(\.\d+)?$")).distinct()
    return found.join(numbers.select("number").distinct(), "number", "left_anti").select("qid", "amount")


def judged(items: DataFrame, sources: DataFrame, parties: DataFrame, numbers: DataFrame) -> DataFrame:
    """(qid, label, reasons, forged, misplaced): the three-way score by all conditions.

    WRONG comes first: no record or a failed one, forbidden tokens (figures are looked for in what the answer attributes to the question's parties), tokens
    without their licence, tokens beside a pattern in one sentence, amounts where none are allowed, forbidden names, forged labels, amounts
    that the cited source lacks, that only a banned file has, or that no chunk has. Else CORRECT if all that is required is there, else SILENT.

    items: qid, type, question, answer, error, refused, warnings, must, any, must_not, must_not_unless (token, licences), cooccur (token, pattern),
    forbid_amounts, names, names_not, local (numbers must be in the cited source), cite_must, cite_must_not, expect_warning, forbid_warning.
    sources: qid, label, file, text. parties: party, aliases, not_aliases. numbers: number.
    """
    none = F.array().cast("array<string>")
    lists = ["must", "must_not", "warnings", "names", "names_not", "cite_must", "cite_must_not", "expect_warning", "forbid_warning"]
    i = items.withColumns({c: F.coalesce(c, none) for c in lists} | {"any": F.coalesce("any", F.array().cast("array<array<string>>"))})
    given = i.where("answer is not null")
    named = mentions(given, ["qid"], "answer", parties).groupBy("qid").agg(F.collect_set("party").alias("_named"))
    clean = given.select("qid", scoped(F.col("answer")).alias("_scoped"))
    ruled = mentions(clean, ["qid"], "_scoped", parties).groupBy("qid").agg(F.collect_set("party").alias("_said"))
    flag = lambda df, name: df.select("qid").distinct().withColumn(name, F.lit(True))
    files = sources.groupBy("qid").agg(F.count("*").alias("_n"), F.collect_set("file").alias("_files"))
    rows = i
    for more in (named, ruled, files, attributed(given, parties), flag(misplaced(given.where("local"), sources), "_misplaced"), flag(banned_sources(given, sources), "_banned"), flag(made_up(given, numbers), "_made_up")):
        rows = rows.join(more, "qid", "left")
    a, s, f = X.normalise(F.col("answer")), X.normalise(scoped(F.col("answer"))), X.normalise(F.col("scope"))
    figure = lambda t: t.rlike(r"^\$?[\d,]+(?:\.\d+)?$")
    refused = F.coalesce("refused", F.lit(False)) | refuses(F.col("answer")) | F.coalesce(F.greatest(*(F.contains(a, F.lit(x)) for x in NEGATIONS)), F.lit(False))
    rows = rows.withColumns({"_a": a, "_s": s, "_f": f, "_refused": refused, "_parts": F.split("answer", SENTENCE_END)} | {c: F.coalesce(c, F.lit(False)) for c in ("_misplaced", "_banned", "_made_up")})
    rows = rows.withColumns({"_n": F.coalesce("_n", F.lit(0)), "_files": F.coalesce("_files", none), "_named": F.coalesce("_named", none), "_said": F.coalesce("_said", none)})
    a, s, f, refused = (F.col(c) for c in ("_a", "_s", "_f", "_refused"))
    forged = F.exists(_labels(F.col("answer")), lambda x: (x < 1) | (x > F.col("_n")))
    beside = F.exists("cooccur", lambda c: F.exists("_parts", lambda p: present(c["token"], X.normalise(p)) & F.regexp_like(p, F.concat(F.lit("(?i)"), c["pattern"]))))
    unlicensed = F.exists("must_not_unless", lambda u: present(u["token"], F.when(figure(u["token"]), f).otherwise(a)) & ~F.exists(u["licences"], lambda x: present(x, a)))
    wrong = {
        "no record": F.col("answer").isNull() & F.col("error").isNull(),
        "error": F.col("error").isNotNull(),
        "forbidden token": F.exists("must_not", lambda t: present(t, F.when(figure(t), f).otherwise(s))),
        "token without licence": unlicensed,
        "token beside pattern": beside,
        "amount given": F.coalesce("forbid_amounts", F.lit(False)) & (F.size(amounts(F.col("scope"))) > 0),
        "forbidden name": F.size(F.array_intersect("names_not", "_said")) > 0,
        "forged label": forged,
        "amount not in the cited source": F.col("_misplaced") & ~refused,
        "amount of a banned file": F.col("_banned"),
        "amount in no chunk": F.col("_made_up") & ~refused,
    }
    refusing = F.col("type") == "refuse"
    no_must, no_any = ~all_present(F.col("must"), a), ~F.forall("any", lambda g: any_present(g, a)) & ~(refusing & refused)
    required = (F.size("must") > 0) | (F.size("any") > 0) | (F.size("names") + F.size("names_not") > 0)
    silent = {
        "required token missing": no_must,
        "none of a group": no_any,
        "required name missing": F.size(F.array_except("names", "_named")) > 0,
        "required source missing": F.exists("cite_must", lambda c: ~F.exists("_files", lambda x: F.contains(x, c))),
        "warning missing": F.exists("expect_warning", lambda w: ~F.exists("warnings", lambda x: F.contains(x, w))),
        "warning fired": F.exists("forbid_warning", lambda w: F.exists("warnings", lambda x: F.contains(x, w))),
        "refused": ~refusing & refused & (~required | no_must | no_any),
    }
    why = lambda d: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in d.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("_wrong", why(wrong)).withColumn("_silent", F.when(F.col("answer").isNull(), none).otherwise(why(silent)))
    label = F.when(F.size("_wrong") > 0, "WRONG").when(F.size("_silent") > 0, "SILENT").otherwise("CORRECT")
    return rows.select("qid", label.alias("label"), F.concat("_wrong", "_silent").alias("reasons"), F.coalesce(forged, F.lit(False)).alias("forged"), F.col("_misplaced").alias("misplaced"))


def class_table(scored: DataFrame, by: str) -> DataFrame:
    """n, correct, silent, wrong, and the wrong ones without a warning, for each class."""
    return scored.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == "CORRECT").alias("correct"),
        F.count_if(F.col("label") == "SILENT").alias("silent"),
        F.count_if(F.col("label") == "WRONG").alias("wrong"),
        F.count_if((F.col("label") == "WRONG") & ~F.col("warned")).alias("silent_wrong"),
    )


def pass_rates(scored: DataFrame, by: str, passed: str = "passed") -> DataFrame:
    """n, passes, rate and its Wilson interval for each class."""
    g = scored.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passes"))
    low, high = stats.wilson(F.col("passes"), F.col("n"))
    return g.select(by, "n", "passes", F.round(F.col("passes") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def scorecard(scored: DataFrame, by: str, passed: str = "passed") -> DataFrame:
    """Each class and TOTAL, by one rollup."""
    g = scored.rollup(by).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passes"), F.grouping(by).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "n", "passes", F.round(F.col("passes") / F.col("n"), 6).alias("rate"))


def paired(a: DataFrame, b: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Two runs over the same items (key, passed): pairs, discordant ones each way, exact p, in all or for each class."""
    both = a.select(key, *([by] if by else []), F.col("passed").alias("_a")).join(b.select(key, F.col("passed").alias("_b")), key)
    g = both.groupBy(*([by] if by else [])).agg(F.count("*").alias("pairs"), F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))
    return g.withColumn("p", F.round(stats.mcnemar(F.col("only_a"), F.col("only_b")), 6))


def pairs_agree(scored: DataFrame, pair: str) -> DataFrame:
    """For each pair of items: all correct, any wrong."""
    return scored.groupBy(pair).agg(F.every(F.col("label") == "CORRECT").alias("all_correct"), F.bool_or(F.col("label") == "WRONG").alias("any_wrong"))


def sweep(runs: DataFrame) -> DataFrame:
    """runs (setting, item, answer, verdict) -> n, correct, distinct answers by their first 120 characters."""
    return runs.groupBy("setting", "item").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.countDistinct(F.left("answer", F.lit(120))).alias("distinct_answers")
    )


def verdicts(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds verdict to runs (item, answer): that of the first rule (item, place, pattern, verdict) whose pattern the lower-cased answer has, else 'ambiguous'.

    Up to BROADCAST_RULES the rules are broadcast, after a count, so that answers stay where they are, however many an item has.
    """
    listed = rules.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", "pattern", F.col("verdict").alias("v")))).alias("_rules"))
    answer = F.lower(F.coalesce("answer", F.lit("")))
    first = F.get(F.filter("_rules", lambda r: F.regexp_like(answer, r["pattern"])), F.lit(0))
    listed = F.broadcast(listed) if rules.count() <= BROADCAST_RULES else listed
    return runs.join(listed, "item", "left").withColumn("verdict", F.coalesce(first["v"], F.lit("ambiguous"))).select(*runs.columns, "verdict")


def best_setting(tallies: DataFrame) -> DataFrame:
    """(setting, mean, distinct_answers, best) of a sweep's tallies: the mean over items of the share correct, and whether it is the best; of equal ones the first setting."""
    means = tallies.groupBy("setting").agg(F.round(F.avg(F.col("correct") / F.col("n")), 6).alias("mean"), F.sum("distinct_answers").alias("distinct_answers"))
    first = means.agg(F.min(F.struct((-F.col("mean")).alias("_m"), "setting")).alias("_first")).select("_first.setting")
    return means.select("setting", "mean", "distinct_answers", (F.col("setting") == first.scalar()).alias("best"))


def fabricated(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, number): numbers of an answer that the corpus (text) has nowhere; small counts aside. Both sides are distinct before they meet."""
    pattern = F.lit(r"\d[\d,]*(?:\.\d+)?")
    known = corpus.select(F.explode(F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), X.bare)).alias("number")).distinct()
    asked = answers.select("qid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("answer", pattern, F.lit(0)), X.bare))).alias("number"))
    return asked.where(~F.col("number").rlike(r"^\d{1,2}$")).join(known, "number", "left_anti").select("qid", "number")


def envelope(table: DataFrame, by: str) -> DataFrame:
    """(line_no, line): a class table with its wrong rate and interval as lines of a markdown table, for a text sink."""
    low, high = stats.wilson(F.col("wrong"), F.col("n"))
    cells = F.concat_ws(" | ", by, *(F.col(c).cast("string") for c in ("n", "correct", "silent", "wrong", "silent_wrong")), F.format_number(F.col("wrong") / F.col("n"), 3), F.concat(F.format_number(low, 3), F.lit("-"), F.format_number(high, 3)))
    rows = table.select(F.col(by).alias("_by"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    head = table.sparkSession.createDataFrame([(0, f"| {by} | n | correct | silent | wrong | silent wrong | rate | interval |"), (1, "|---" * 8 + "|")], "line_no int, line string")
    return head.union(rows.select((F.row_number().over(Window.orderBy("_by")) + 1).alias("line_no"), "line"))


def sealed_gap(scored: DataFrame) -> DataFrame:
    """public, sealed, gap: share correct of public and sealed items, and the difference."""
    rate = lambda sealed: F.avg(F.when(F.col("sealed") == sealed, (F.col("label") == "CORRECT").cast("double")))
    g = scored.agg(rate(False).alias("public"), rate(True).alias("sealed"))
    return g.withColumn("gap", F.col("public") - F.col("sealed"))


def faithfulness(claims: DataFrame, flagged: DataFrame, corpus_numbers: DataFrame) -> DataFrame:
    """(scope, claims, grounded, fabricated, coverage_gap): flagged numbers that the corpus has are gaps of coverage, the others made up.

    claims: scope, grounded. flagged: scope, number. corpus_numbers: number, repeated or not.
    """
    split = flagged.join(corpus_numbers.select("number").distinct().withColumn("_known", F.lit(True)), "number", "left").groupBy("scope").agg(F.count_if(F.col("_known").isNull()).alias("fabricated"), F.count_if(F.col("_known")).alias("coverage_gap"))
    counted = claims.groupBy("scope").agg(F.count("*").alias("claims"), F.count_if("grounded").alias("grounded"))
    return counted.join(split, "scope", "left").select("scope", "claims", "grounded", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fabricated", "coverage_gap")))
