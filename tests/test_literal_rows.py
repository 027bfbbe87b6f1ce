"""Literal rows with what each operator gives for them: rules and silences that no table shows."""

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import corpus, score, segment, threads, verify
from lexgrove.plans.cases import ROUTING, Table
from lexgrove.sources.files import parse_questions
from lexgrove.streaming import live

SENDERS = Table("sender string", [("Ines Halvorsen",), ("Tomas Brandl",), ("Al Ng",), ("이수진",), ("Reply Bot",)])
SUBJECTS = Table("id bigint, subject string", [
    (1, "Re: Fw: fees"), (2, "AW: Angebot"), (3, "WG: Angebot"), (4, "Fees"), (5, "  re:RE: x"), (6, None), (7, "Regarding: fees"), (8, "전달: 보고"),
])
PARTIES = Table("id bigint, party string", [
    (1, "Ines Halvorsen <ines@example.com>"), (2, '"Brandl, Tomas" <d@example.com>'), (3, "someone@example.com"), (4, "  Plain Name "), (5, None), (6, "<x@example.com>"),
])
MARKDOWN = Table("file string, text string", [
    ("a.md", "# Plan\n\nFirst paragraph.\n\nSecond paragraph.\n\n| a | b |\n| 1 | 2 |\n\nAfter the table.\n## Fees\nThe fee is 4,800.\n## 2024-05-07 A -> B\nHello."),
    ("b.md", "No heading.\n\nStill none.\n\f# Second page\nText."),
    ("c.md", "\n\n   \n"),
])
ANSWERS = Table("qid bigint, question string, answer string", [
    (1, "What did Alpha quote?", "- Firm Alpha quoted $19,500 [S2].\n- The cap is 75,000 [S1]."),
    (2, "Is nineteen thousand five hundred right?", "Yes, 19,500 [S2] is right. See [S9]."),
    (3, "Under which section?", "It falls under section 112 [S2].\nTherefore it is $4,800 in all [S2]."),
    (4, "Did Bravo reply?", "Firm Bravo did not reply [S1]. Firm Echo never responded."),
    (5, "Who said so?", "Firm Charlie said the fee is low [S3], [S1][S2][S3][S1][S2]."),
    (6, "Anything?", "Not in the documents."),
    (7, "Sum?", "The total is 19,500 + 4,800 = 24,300 [INFERENCE] [S1, S2]."),
])
_S = [
    (1, "alpha/fees.md", "Fee cap of $75,000", "The estimate of Firm Alpha is 19,500 for 35 U.S.C. 112 work."),
    (2, "bravo/mail.eml", "2024-05-07 Firm Bravo -> Firm Charlie", "We propose 4,800."),
    (3, "alpha/note.md", "", "Other text."),
]
SOURCES = Table("qid bigint, label int, file string, heading string, text string", [(q, *s) for q in range(1, 8) for s in _S])
SPELLED = Table("id bigint, text string", [
    (1, "nineteen thousand five hundred"), (2, "one hundred and one, then two million"), (3, "no figures and none"), (4, "twenty one or thirty"), (5, None), (6, "a hundred thousand"),
])
_NO: list = []
ITEMS = Table(
    "n bigint, type string, answer string, refused boolean, must array<string>, any array<array<string>>, must_not array<string>, facts array<array<string>>, min_facts int, n_sources int, labels array<int>",
    [
        (1, "fact", "The fee is $12,500 [S1].", False, ["$12,500"], _NO, _NO, _NO, None, 2, [1]),
        (2, "fact", "It was on 7 May.", False, ["May 7"], _NO, ["June 1"], _NO, None, 2, _NO),
        (3, "fact", "There are 24 of them, in 2024.", False, ["20"], _NO, _NO, _NO, None, 2, _NO),
        (4, "list", "Alpha and Bravo.", False, ["Alpha"], [["Bravo", "Charlie"], ["Delta"]], _NO, _NO, None, 2, _NO),
        (5, "refuse", "That is not specified in the sources.", False, _NO, _NO, ["$5,000"], _NO, None, 2, _NO),
        (6, "refuse", "It costs $5,000.", False, _NO, _NO, ["$5,000"], _NO, None, 2, _NO),
        (7, "summary", "Fees rose. Bravo left.", False, _NO, _NO, _NO, [["fees"], ["bravo"], ["echo"]], 2, 2, _NO),
        (8, "fact", "The fee is 12,500 [S7].", False, ["12,500"], _NO, _NO, _NO, None, 2, [7]),
        (9, "fact", None, None, ["x"], _NO, _NO, _NO, None, 0, _NO),
        (10, "fact", "Not in the documents.", True, _NO, _NO, _NO, _NO, None, 0, _NO),
    ],
)
OVERRIDES = Table("qid bigint, value string", [
    (1, "What is the fee?"), (2, "--only firm-alpha/2026 --top-k 8 :: What is the fee?"), (3, "--diverse :: a :: b"), (4, "--wrong 3 :: x"), (5, "--top-k many :: x"), (6, " :: plain"),
])
_D = "data: "
FRAMES = Table("answer_id bigint, seq bigint, line string", [
    (1, 1, _D + '{"choices":[{"delta":{"content":"The fee "}}]}'), (1, 3, _D + '{"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total_tokens":12}}'),
    (1, 2, _D + '{"choices":[{"delta":{"content":"is 5."}}]}'), (1, 4, _D + "[DONE]"), (2, 1, "event: error"), (2, 2, _D + '{"error":{"message":"no model"}}'), (3, 1, ": ping"), (3, 2, _D + "[DONE]"),
    (4, 1, _D + "not json"), (4, 2, _D + '{"choices":[{"delta":{"content":"cut"},"finish_reason":"length"}]}'),
])

_R = {1: "alpha/fees.md > Fee cap of $75,000", 2: "bravo/mail.eml > 2024-05-07 Firm Bravo -> Firm Charlie", 3: "alpha/note.md > (no heading)"}


def _resolved(answer):
    for old, new in [("[S1, S2]", f"[S1: {_R[1]}; S2: {_R[2]}]"), *((f"[S{n}]", f"[S{n}: {_R[n]}]") for n in _R)]:
        answer = answer.replace(old, new)
    return answer


def check_of(f):
    return lambda rows: f(rows(ANSWERS), rows(SOURCES))


CASES = {
    "senders_named": (lambda rows: threads.senders_named(rows(ROUTING), rows(SENDERS)), [(1, "Ines Halvorsen"), (3, "Tomas Brandl")]),
    "ordinals_named": (lambda rows: rows(ROUTING).select("qid", threads.ordinals_named(F.col("question"))), [(1, 2), (2, None), (3, -1), (4, None), (5, None), (6, -1), (7, None)]),
    "subject_verbs": (
        lambda rows: rows(SUBJECTS).select("id", X.base_subject(F.col("subject")), X.subject_verb(F.col("subject"), F.lit(False), F.lit(False))),
        [(1, "fees", "replied"), (2, "Angebot", "replied"), (3, "Angebot", "forwarded"), (4, "Fees", "wrote"), (5, "x", "replied"), (6, "", "wrote"), (7, "Regarding: fees", "wrote"), (8, "보고", "forwarded")],
    ),
    "display_names": (lambda rows: rows(PARTIES).select("id", X.display_name(F.col("party"))), [(1, "Ines Halvorsen"), (2, "Brandl, Tomas"), (3, "someone@example.com"), (4, "Plain Name"), (5, ""), (6, "<x@example.com>")]),
    "verify_citation_numbers": (check_of(verify.mis_cited), [(1, "19,500", "S2", "S1")]),
    "verify_citations": (check_of(verify.forged), [(2, 9)]),
    "verify_attribution": (check_of(verify.unverified_attributions), [(5, "Firm Charlie")]),
    "verify_negatives": (check_of(verify.unverified_negatives), [(4, "Firm Bravo")]),
    "verify_grounding": (lambda rows: verify.ungrounded(rows(ANSWERS)), [(6, 0, "Not in the documents."), (7, 0, "The total is 19,500 + 4,800 = 24,300 [INFERENCE] [S1, S2].")]),
    "inference_labels": (lambda rows: rows(ANSWERS).select("qid", verify.missing_inference(F.col("answer"))), [(q, q == 3) for q in range(1, 8)]),
    "cap_citations": (lambda rows: rows(ANSWERS).select("qid", verify.cap_citations(F.col("answer"))), [(q, "Firm Charlie said the fee is low [S3], [S1][S2][S3]." if q == 5 else a) for q, _, a in ANSWERS.rows]),
    "resolve_citations": (check_of(verify.resolve_citations), [(q, _resolved(a)) for q, _, a in ANSWERS.rows]),
    "spelled_numbers": (lambda rows: rows(SPELLED).select("id", F.array_join(verify.spelled_numbers(F.col("text")), ",")), [(1, "19500"), (2, "101,2000000"), (3, ""), (4, "21,30"), (5, ""), (6, "100000")]),
    "score_items": (lambda rows: score.passes(rows(ITEMS)).select("n", "passed"), list(enumerate([True, True, False, False, True, False, True, True, False, False], 1))),
    "score_three_way": (lambda rows: score.three_way(rows(ITEMS)).select("n", "label"), list(enumerate(["CORRECT", "CORRECT", "SILENT", "SILENT", "CORRECT", "WRONG", "CORRECT", "WRONG", "WRONG", "CORRECT"], 1))),
    "question_overrides": (
        lambda rows: parse_questions(rows(OVERRIDES)).select("qid", "scope", "top_k", "diverse", "question", F.col("error").isNotNull()),
        [(1, None, None, False, "What is the fee?", False), (2, "firm-alpha/2026", 8, False, "What is the fee?", False), (3, None, None, True, "a :: b", False), (4, None, None, False, "x", True), (5, None, None, False, "x", True), (6, None, None, False, "plain", False)],
    ),
    "markdown_chunks": (
        lambda rows: segment.chunk(rows(MARKDOWN)).select("chunk_id", "heading", "title", "text"),
        [
            ("a.md#0", "Plan", "", "First paragraph.\n\nSecond paragraph."), ("a.md#1", "Plan", "", "| a | b |\n| 1 | 2 |"), ("a.md#2", "Plan", "", "After the table."), ("a.md#3", "Fees", "Plan", "The fee is 4,800."),
            ("a.md#4", "2024-05-07 A -> B", "", "Hello."), ("b.md#0", "page 1", "", "No heading.\n\nStill none."), ("b.md#1", "page 2 / Second page", "", "Text."),
        ],
    ),
    "stream_answers": (
        lambda rows: live.answers(rows(FRAMES)).select("answer_id", "answer", "tokens", "finish", "error"),
        [(1, "The fee is 5.", 12, "stop", None), (2, "", None, None, "no model"), (3, "", None, None, "empty stream"), (4, "cut", None, "length", None)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_literal_rows(spark, name):
    made, want = CASES[name]
    got = made(lambda t: spark.createDataFrame(t.rows, t.schema))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_haystack_of_filler(spark):
    got = corpus.haystack(spark, 2000, "The vault code is 4711.", 0.5)
    assert [r.pos for r in got.where("contains(text, '4711')").collect()] == [1000] and got.count() == 2000
