"""What the given tables have nothing of, made from their rows: answers and their sources, questions, subjects, parties, markdown, frames. Each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.threads import ORDINALS
from ..operators.verify import ONES

#: An answer for each document, by its number; {fee} and {other} are amounts of its own.
ANSWERS = [
    "Firm Alpha quoted ${fee} [S2].",
    "The fee is {fee} [S1].",
    "The fee is {other} [S1].",
    "Firm Charlie said so [S1], and Firm Alpha agreed.",
    "Firm Bravo did not reply [S1]. Firm Echo never responded.",
    "Firm Bravo did not reply before May [S1].",
    "Not in the documents.",
    "It falls under section {fee} [S2].",
    "See [S9] and [S2]; also [S12, S1].",
    "Therefore the sum is {fee} + {fee} [S1].",
    "The sum = {fee} [INFERENCE] [S1, S2].",
    "- It is low [S3], [S1][S2][S3][S1][S2].\n2. An item without any citation.\n- Short one",
    "The fee is {fee} [S1], and {fee} [S2] again. It is {other} [S2].",
]
_MAIL = "2024-05-07 Firm Bravo -> Firm Charlie"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _filled(template: str, **amounts: Column) -> Column:
    out = F.lit(template)
    for name, c in amounts.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def _chosen(of: Column, values: list) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


def _amounts() -> dict[str, Column]:
    return {"fee": F.format_number(F.col("doc_id") + 11000, 0), "other": F.format_number(F.col("doc_id") + 2311000, 0)}


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question, answer): one for each document; some questions name the amount themselves."""
    d, a = _t(spark, sf, "documents"), _amounts()
    question = F.when(F.col("doc_id") % 26 == 13, _filled("Is it {fee}?", **a)).otherwise("What did Alpha quote?")
    answer = _filled("{x}", x=_chosen(F.col("doc_id"), ANSWERS))
    for name, c in a.items():
        answer = F.replace(answer, F.lit("{" + name + "}"), c)
    return d.select(F.col("doc_id").alias("qid"), question.alias("question"), answer.alias("answer"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, label, file, heading, text): a schedule, a mail, and the document itself."""
    d, a = _t(spark, sf, "documents"), _amounts()
    fee = _filled("Firm Alpha estimates {fee} for 35 U.S.C. 112 work.", **a)
    low = F.concat(F.lit("We propose "), (F.col("doc_id") % 900 + 100).cast("string"), F.lit("."))
    row = lambda n, file, heading, text: F.struct(F.lit(n).alias("label"), file.alias("file"), heading.alias("heading"), text.alias("text"))
    own = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    rows = F.array(row(1, F.lit("alpha/fees.md"), F.lit("Fee schedule"), fee), row(2, F.lit("bravo/mail.eml"), F.lit(_MAIL), low), row(3, own, F.col("lang"), F.col("text")))
    return d.select(F.col("doc_id").alias("qid"), F.explode(rows).alias("s")).select("qid", "s.*")


def _in_words(n: Column) -> Column:
    """1 to 999,999 in words."""
    words, tens = list(ONES), [w for w, v in ONES.items() if v >= 20]
    pick = lambda of, i: F.element_at(F.array(*map(F.lit, of)), i.cast("int") + 1)

    def hundred(x: Column) -> Column:
        high = F.concat_ws(" ", pick(tens, F.greatest(F.floor(x / 10) - 2, F.lit(0))), F.when(x % 10 > 0, pick(words, x % 10)))
        return F.when(x < 20, pick(words, x)).otherwise(high)

    def thousand(x: Column) -> Column:
        h, rest = F.floor(x / 100), x % 100
        return F.when(h == 0, hundred(rest)).otherwise(F.concat_ws(" ", pick(words, h), F.lit("hundred"), F.when(rest > 0, F.concat(F.lit("and "), hundred(rest)))))

    t, rest = F.floor(n / 1000), n % 1000
    return F.concat_ws(" ", F.when(t > 0, F.concat(thousand(t), F.lit(" thousand"))), F.when((rest > 0) | (t == 0), thousand(rest)))


def spelled(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): two amounts of each order in words."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("It costs "), _in_words(k * 37 % 999983 + 1), F.lit(" dollars, or "), _in_words(k % 900 + 1), F.lit(" a year."))
    return _t(spark, sf, "orders").select(k.alias("id"), text.alias("text"))


def senders(spark: SparkSession, sf: str) -> DataFrame:
    """(sender): each customer's number as a word, and a word that names nobody."""
    name = F.translate(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    return _t(spark, sf, "customer").select(F.concat(F.initcap(name), F.lit(" Office")).alias("sender"))


def sender_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question): each document asks about a customer, each third one about another too."""
    word = lambda n: F.translate(F.lpad(n.cast("string"), 6, "0"), "0123456789", "abcdefghij")
    d, k = _t(spark, sf, "documents"), F.col("doc_id")
    more = F.when(k % 3 == 0, F.concat(F.lit(" and "), F.initcap(word(k % 700)))).otherwise("")
    return d.select(k.alias("qid"), F.concat(F.lit("What did "), word(k % 1000), more, F.lit(" of the office say about "), F.left("text", F.lit(60))).alias("question"))


_COMPARED = ["Compare his first and second reply", "The first message, and then the last email?", "Nothing of the kind"]
_ORDINALS = [f"What was in her {w} {m}?" for w, m in zip(ORDINALS, ["reply", "message", "email", "note"] * len(ORDINALS), strict=False)] + _COMPARED


def ordinal_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question): each document asks with one of the ordinals, or compares."""
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.concat(_chosen(F.col("doc_id"), _ORDINALS), F.lit(" "), F.left("text", F.lit(40))).alias("question"))


_PREFIXES = [("Re: ", "replied"), ("AW: Fw: ", "replied"), ("WG: ", "forwarded"), ("", "wrote"), ("  re:RE: ", "replied"), ("전달: ", "forwarded"), ("Regarding: ", "wrote")]


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """(id, subject): each conversation's turns as replies and forwards; the eighth has none."""
    c = _t(spark, sf, "conversations")
    number = F.col("conv_id") * 100 + F.col("turn")
    made = F.concat(_chosen(number, [p for p, _ in _PREFIXES]), F.lit("Topic "), F.col("conv_id").cast("string"))
    return c.select(number.alias("id"), F.when(F.col("turn") != 7, made).alias("subject"))


def parties(spark: SparkSession, sf: str) -> DataFrame:
    """(id, party): customers as mail writes them."""
    k, name = F.col("c_custkey"), F.col("c_name")
    at = F.concat(F.lit("<c"), k.cast("string"), F.lit("@x.example>"))
    forms = [F.concat(name, F.lit(" "), at), F.concat(F.lit('"'), name, F.lit(', Ltd" '), at), F.concat(F.lit("  "), name, F.lit(" ")), F.lit(None).cast("string"), at]
    return _t(spark, sf, "customer").select(k.alias("id"), _chosen(k, forms).alias("party"))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """(file, text): a conversation as a document: a title, a heading for each turn (some as a mail's), two paragraphs, and a table in each third turn."""
    c = _t(spark, sf, "conversations").withColumn("flat", F.regexp_replace("text", r"\s+", " "))
    turn = F.col("turn").cast("string")
    heading = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("## 2024-05-0"), turn, F.lit(" A -> B"))).otherwise(F.concat(F.lit("## "), F.col("role"), F.lit(" "), turn))
    table = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("| turn | role |\n| "), turn, F.lit(" | "), F.col("role"), F.lit(" |\n\n"))).otherwise("")
    block = F.concat(heading, F.lit("\n\nSaid: "), F.left("flat", F.lit(100)), F.lit("\n\n"), table, F.lit("More: "), F.substring("flat", 101, 100), F.lit("\n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n")
    return c.groupBy("conv_id").agg(joined.alias("b")).select(F.concat(F.col("conv_id").cast("string"), F.lit(".md")).alias("file"), F.concat(F.lit("# Talk "), F.col("conv_id").cast("string"), F.lit("\n\n"), "b").alias("text"))


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, value): documents as lines of a question file."""
    d, k = _t(spark, sf, "documents"), F.col("doc_id")
    q = F.trim(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)))
    flags = [F.lit(""), F.concat(F.lit("--only "), F.col("source"), F.lit("/x --top-k "), (k % 20).cast("string"), F.lit(" :: ")), F.lit("--diverse :: a :: "), F.lit("--wrong 3 :: "), F.lit("--top-k many :: "), F.lit(" :: ")]
    return d.where(q != "").select(k.alias("qid"), F.concat(_chosen(k, flags), q).alias("value"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """(answer_id, seq, line): each conversation's texts as one answer that arrives in pieces, two for each turn; then its end: an error, a cut, or counts and a stop."""
    c = _t(spark, sf, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    data = lambda x: F.concat(F.lit("data: "), x)
    piece = lambda x: data(F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
    parts = F.array(F.struct((F.col("turn") * 2).alias("seq"), piece(F.left("text", half)).alias("line")), F.struct((F.col("turn") * 2 + 1).alias("seq"), piece(F.substring("text", half + 1, F.length("text"))).alias("line")))
    said = c.select(F.col("conv_id").alias("answer_id"), F.explode(parts).alias("p")).select("answer_id", "p.seq", "p.line")
    ends = c.groupBy(F.col("conv_id").alias("answer_id")).agg(F.sum(F.length("text")).alias("n"))
    stop = data(F.concat(F.lit('{"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total_tokens":'), F.col("n").cast("string"), F.lit("}}")))
    last = F.when(F.col("answer_id") % 5 == 0, data(F.lit('{"error":{"message":"no model"}}'))).when(F.col("answer_id") % 5 == 1, data(F.lit('{"choices":[{"delta":{},"finish_reason":"length"}]}'))).otherwise(stop)
    tail = F.array(F.struct(F.lit(10**6).cast("long").alias("seq"), last.alias("line")), F.struct(F.lit(10**6 + 1).cast("long").alias("seq"), F.lit("data: [DONE]").alias("line")), F.struct(F.lit(10**6 + 2).cast("long").alias("seq"), F.lit(": ping").alias("line")))
    return said.union(ends.select("answer_id", F.explode(tail).alias("p")).select("answer_id", "p.seq", "p.line"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with keys, of all types: (n, type, answer, refused, must, any, must_not, facts, min_facts, n_sources, labels)."""
    d, fee = _t(spark, sf, "documents"), _amounts()["fee"]
    k = F.col("doc_id") % 10
    number = (F.col("doc_id") % 900 + 100).cast("string")
    text, none = (lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))), F.array().cast("array<string>")
    dollars = text("$", fee)
    answer = _chosen(F.col("doc_id"), [
        text("The fee is ", dollars, " [S1]."), text("It was on 7 May."), text("There are ", number, "4 of them, in 2024."), text("Alpha and ", F.col("lang"), "."), text("That is not specified in the sources."),
        text("It costs ", dollars, "."), text("Fees rose in ", F.col("source"), ". Bravo left."), text("The fee is ", fee, " [S7]."), F.lit(None).cast("string"), text("Not in the documents."),
    ])
    must = _chosen(F.col("doc_id"), [F.array(dollars), F.array(F.lit("May 7")), F.array(number), F.array(F.lit("Alpha")), none, none, none, F.array(fee), F.array(F.lit("x")), none])
    groups = F.when(k == 3, F.array(F.array(F.lit("en"), F.lit("de")), F.array(F.lit("Alpha"), F.lit("Delta")))).otherwise(F.array().cast("array<array<string>>"))
    facts = F.when(k == 6, F.array(F.array(F.lit("fees")), F.array(F.col("source")), F.array(F.lit("echo")))).otherwise(F.array().cast("array<array<string>>"))
    kind = F.when(k.isin(4, 5), "refuse").when(k == 3, "list").when(k == 6, "summary").otherwise("fact")
    return d.select(
        F.col("doc_id").alias("n"), kind.alias("type"), answer.alias("answer"), (k == 9).alias("refused"), must.alias("must"), groups.alias("any"), F.when(k.isin(4, 5), F.array(dollars)).otherwise(none).alias("must_not"), facts.alias("facts"),
        F.when(k == 6, 2).alias("min_facts"), F.lit(2).alias("n_sources"), F.when(k == 7, F.array(F.lit(7))).when(k == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("labels"),
    )


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """(file, line_no, line): each conversation as one mail: its last turn on top, every earlier one quoted in it, a level deeper each, in three styles."""
    c = _t(spark, sf, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    turn, who, style = F.col("turn").cast("string"), F.col("role"), F.col("conv_id") % 3
    party = F.concat(F.initcap(who), F.lit(" Party <"), who, F.lit("@x.example>"))
    block = F.concat(F.lit("From: "), party, F.lit("\nSent: Tuesday, March 5, 2026 4:4"), turn, F.lit(" PM\nTo: Someone <s@x.example>\nSubject: RE: topic "), turn, F.lit("\n\n"))
    german = F.concat(F.lit("-----Original Message-----\n**Von:** "), party, F.lit("\nGesendet: 0"), turn, F.lit(".03.2026 10:00\nAn: Jemand\nBetreff: AW: topic "), turn, F.lit("\n\n"))
    wrote = F.concat(F.lit("On Mon, Mar 4, 2026 at 9:1"), turn, F.lit(" AM "), party, F.when(F.col("turn") % 2 == 0, F.lit(" wrote:\n")).otherwise("\nwrote:\n"))
    own = F.concat(F.when(F.col("turn") == F.col("_last"), "").when(style == 0, block).when(style == 1, wrote).otherwise(german), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    marks = F.repeat(F.lit("> "), (F.col("_last") - F.col("turn")).cast("int"))
    rows = c.withColumn("_last", last).select("conv_id", (F.col("_last") - F.col("turn")).alias("depth"), marks.alias("marks"), F.posexplode(F.split(own, "\n")).alias("k", "l"))
    number = F.col("depth") * 1_000_000 + F.col("k")
    return rows.select(F.col("conv_id").cast("string").alias("file"), number.alias("line_no"), F.concat("marks", "l").alias("line"))


# -- the same in SQL
def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


ANSWERS_SQL = f"""amount AS (SELECT *, doc_id AS qid, format('{{:,}}', doc_id + 11000) AS fee, format('{{:,}}', doc_id + 2311000) AS other FROM documents),
answers AS (SELECT qid, fee, text, source || '/' || doc_id AS own, lang, CASE WHEN doc_id % 26 = 13 THEN 'Is it ' || fee || '?' ELSE 'What did Alpha quote?' END AS question,
  replace(replace(({_list(ANSWERS)})[(doc_id % {len(ANSWERS)} + 1)::INT], '{{fee}}', fee), '{{other}}', other) AS answer FROM amount)"""
_GIVEN = {1: "'alpha/fees.md > Fee schedule'", 2: f"'bravo/mail.eml > {_MAIL}'", 3: "own || ' > ' || lang"}


def _resolved() -> str:
    out = f"replace(replace(answer, '[S1, S2]', '[S1: ' || {_GIVEN[1]} || '; S2: ' || {_GIVEN[2]} || ']'), '[S12, S1]', '[S12; S1: ' || {_GIVEN[1]} || ']')"
    for n, given in _GIVEN.items():
        out = f"replace({out}, '[S{n}]', '[S{n}: ' || {given} || ']')"
    return out


_LABELS = r"unnest(list_distinct(flatten(list_transform(regexp_extract_all(answer, '\[(S\d+(\s*[,;]\s*S?\d+)*)\]', 1), lambda b: regexp_extract_all(b, '\d+'))))::BIGINT[])"
_DIGITS = "translate(lpad(({})::VARCHAR, 6, '0'), '0123456789', 'abcdefghij')"
SQL = {
    "verify_citation_numbers": f"""WITH {ANSWERS_SQL}
SELECT qid, fee AS number, 'S2' AS cited, 'S1' || CASE WHEN list_contains(regexp_extract_all(replace(lang || chr(10) || text, ',', ''), '\\d+'), replace(fee, ',', '')) THEN ', S3' ELSE '' END AS found
FROM answers WHERE starts_with(answer, 'Firm Alpha quoted') AND NOT contains(question, fee)""",
    "verify_citations": f"WITH {ANSWERS_SQL}, c AS (SELECT qid, {_LABELS} AS label FROM answers) SELECT qid, label FROM c WHERE label < 1 OR label > 3",
    "verify_attribution": rf"WITH {ANSWERS_SQL}, n AS (SELECT qid, unnest(list_distinct(regexp_extract_all(answer, '\b(Firm [A-Z]\w+)\s+(quoted|said|agreed|replied)\b', 1))) AS name FROM answers) SELECT qid, name FROM n WHERE contains('Firm Charlie', name)",
    "verify_negatives": rf"""WITH {ANSWERS_SQL}, n AS (SELECT qid, unnest(list_distinct(regexp_extract_all(answer, '\b(Firm [A-Z]\w+)\s+(did not|never)\s+(reply|responded)(\s\[|\.)', 1))) AS party FROM answers)
SELECT qid, party FROM n WHERE contains('{_MAIL.split(" -> ")[0]}', party)""",
    "verify_grounding": rf"""WITH {ANSWERS_SQL}, l AS (SELECT qid, string_split(answer, chr(10)) AS l FROM answers),
c AS (SELECT qid, unnest(range(len(l))) AS claim_no, trim(regexp_replace(unnest(l), '^[\s\-*+•\d.)\]]+', '')) AS claim FROM l)
SELECT qid, claim_no, claim FROM c WHERE len(string_split_regex(claim, '\s+')) >= 4 AND NOT regexp_matches(claim, '\[S\d+\]')""",
    "inference_labels": rf"""WITH {ANSWERS_SQL}
SELECT qid, regexp_matches(answer, '(?i)=|\b(conclusion|therefore|closest|closer|would not|does not qualify)\b') AND NOT contains(upper(answer), '[INFERENCE]') AS missing FROM answers""",
    "cap_citations": rf"WITH {ANSWERS_SQL} SELECT qid, regexp_replace(answer, '((\[S\d+\]\s*){{2}}\[S\d+\])(\s*\[S\d+\])+', '\1', 'g') AS answer FROM answers",
    "resolve_citations": f"WITH {ANSWERS_SQL} SELECT qid, {_resolved()} AS answer FROM answers",
    "spelled_numbers": """SELECT o_orderkey AS id, CASE WHEN o_orderkey * 37 % 999983 = o_orderkey % 900 THEN (o_orderkey % 900 + 1)::VARCHAR ELSE (o_orderkey * 37 % 999983 + 1) || ',' || (o_orderkey % 900 + 1) END AS numbers FROM orders""",
    "senders_named": f"""WITH s AS (SELECT {_DIGITS.format('c_custkey')} AS word FROM customer),
q AS (SELECT doc_id, 'what did ' || {_DIGITS.format('doc_id % 1000')} || CASE WHEN doc_id % 3 = 0 THEN ' and ' || {_DIGITS.format('doc_id % 700')} ELSE '' END || ' of the office say about ' || left(text, 60) AS question FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM q)
SELECT doc_id AS qid, upper(word[1]) || word[2:] || ' Office' AS sender FROM w JOIN s USING (word)""",
    "ordinals_named": f"SELECT doc_id AS qid, ([{', '.join(str(v) for v in ORDINALS.values())}, NULL, NULL, NULL]::BIGINT[])[(doc_id % {len(_ORDINALS)} + 1)::INT] AS ordinal FROM documents",
    "subject_verbs": f"""WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn FROM conversations)
SELECT id, CASE WHEN turn = 7 THEN '' WHEN id % {len(_PREFIXES)} = {len(_PREFIXES) - 1} THEN 'Regarding: Topic ' || conv_id ELSE 'Topic ' || conv_id END AS base,
  CASE WHEN turn = 7 THEN 'wrote' ELSE ({_list([v for _, v in _PREFIXES])})[(id % {len(_PREFIXES)} + 1)::INT] END AS verb FROM c""",
    "display_names": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || ', Ltd' WHEN 2 THEN c_name WHEN 3 THEN '' ELSE '<c' || c_custkey || '@x.example>' END AS name FROM customer",
    "markdown_chunks": r"""WITH c AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM conversations),
p AS (SELECT conv_id, turn, role, trim('Said: ' || left(flat, 100)) AS said, trim('More: ' || substr(flat, 101, 100)) AS more FROM c),
x AS (SELECT conv_id, turn, 0 AS part, CASE WHEN turn % 3 = 2 THEN said ELSE said || chr(10) || chr(10) || more END AS text FROM p
  UNION ALL SELECT conv_id, turn, 1, '| turn | role |' || chr(10) || '| ' || turn || ' | ' || role || ' |' FROM p WHERE turn % 3 = 2 UNION ALL SELECT conv_id, turn, 2, more FROM p WHERE turn % 3 = 2)
SELECT conv_id || '.md#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1) AS chunk_id, CASE WHEN turn % 4 = 3 THEN '2024-05-0' || turn || ' A -> B' ELSE role || ' ' || turn END AS heading,
  CASE WHEN turn % 4 = 3 THEN '' ELSE 'Talk ' || conv_id END AS title, x.text FROM x JOIN p USING (conv_id, turn)""",
    "question_overrides": r"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, source, trim(left(regexp_replace(text, '\s+', ' ', 'g'), 40)) AS q FROM documents)
SELECT doc_id AS qid, CASE WHEN k = 1 THEN source || '/x' END AS scope, CASE WHEN k = 1 THEN doc_id % 20 END AS top_k, k = 2 AS diverse, CASE WHEN k = 2 THEN 'a :: ' || q ELSE q END AS question, k IN (3, 4) AS bad FROM d WHERE q <> ''""",
    "stream_answers": """SELECT conv_id AS answer_id, string_agg(text, '' ORDER BY turn) AS answer, CASE WHEN conv_id % 5 > 1 THEN sum(length(text))::BIGINT END AS tokens,
  CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'length' ELSE 'stop' END AS finish, CASE WHEN conv_id % 5 = 0 THEN 'no model' END AS error FROM conversations GROUP BY conv_id""",
    "haystack": "SELECT doc_id AS pos, doc_id = (SELECT quantile_disc(doc_id, 0.5) FROM documents) AS needle FROM documents",
    "thread_split": r"""WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, upper(role[1]) || role[2:] || ' Party <' || role || '@x.example>' AS party FROM conversations)
SELECT conv_id::VARCHAR AS file, last - turn AS pos, CASE WHEN turn = last THEN '' ELSE party END AS sender, CASE WHEN turn = last OR conv_id % 3 = 1 THEN '' WHEN conv_id % 3 = 0 THEN 'Someone <s@x.example>' ELSE 'Jemand' END AS recipient,
  CASE WHEN turn = last OR conv_id % 3 = 1 THEN '' WHEN conv_id % 3 = 0 THEN 'RE: topic ' || turn ELSE 'AW: topic ' || turn END AS subject,
  CASE WHEN turn = last THEN '' WHEN conv_id % 3 = 0 THEN 'Tuesday, March 5, 2026 4:4' || turn || ' PM' WHEN conv_id % 3 = 1 THEN 'Mon, Mar 4, 2026 at 9:1' || turn || ' AM ' || party ELSE '0' || turn || '.03.2026 10:00' END AS date_raw,
  sha256(regexp_replace(regexp_replace(text, '^\s*
', ''), '
\s*$', '')) AS sha256 FROM c""",
    # of the keys: k = 3 needs one of two languages, k = 6 two of three facts
    "score_items": "SELECT doc_id AS n, CASE doc_id % 10 WHEN 2 THEN false WHEN 3 THEN lang IN ('en', 'de') WHEN 5 THEN false WHEN 8 THEN false WHEN 9 THEN false ELSE true END AS passed FROM documents",
    "score_three_way": "SELECT doc_id AS n, CASE doc_id % 10 WHEN 2 THEN 'SILENT' WHEN 3 THEN CASE WHEN lang IN ('en', 'de') THEN 'CORRECT' ELSE 'SILENT' END WHEN 5 THEN 'WRONG' WHEN 7 THEN 'WRONG' WHEN 8 THEN 'WRONG' ELSE 'CORRECT' END AS label FROM documents",
}
