"""Small literal tables: questions, scopes and rules that queries apply to the given tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    schema: str
    rows: list[tuple]

    def sql(self) -> str:
        """The table as a SQL VALUES list, for strings, numbers, booleans and nulls."""
        def one(v):
            if isinstance(v, int) and not isinstance(v, bool):
                return f"{v}::BIGINT"
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        names = ", ".join(c.split()[0] for c in self.schema.split(", "))
        return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in self.rows)}) AS t({names})"


QUESTIONS = Table("qid bigint, question string", [
    (1001, "Compare the and of in src1 and src2: eaer thion nd?"),
    (1002, "What of src3, src7 and src12 on ertion and reer"),
    (1003, "Only src5 is named here"),
    (1004, "zzzz qqqq xxxx"),
    (1005, "No folder at all, but thion erhe ou"),
])
SCOPES = Table("scope string", [("src1",), ("src1/",), ("src",), ("",), ("src10/10",), ("src2//",)])
ROUTING = Table("qid bigint, question string", [
    (1, "What did Ines say in her second reply?"),
    (2, "Compare his first and second reply"),
    (3, "What was in the last email of Tomas Brandl on May 7?"),
    (4, "Summarise the message of 1995-03-12, please."),
    (5, "Who wrote on 3/14/1996 and on 12 March?"),
    (6, "the most recent message, the newest one"),
    (7, "nothing to route here"),
])
ALIASES = Table("party string, aliases array<string>, not_aliases array<string>", [("Alpha", ["Firm Alpha", "Alpha"], ["Alpha IP Group"]), ("Bravo", ["Firm Bravo", "Bravo"], None)])
VERDICTS = Table("item string, place int, pattern string, verdict string", [("en", 1, "[0-9]{3}", "wrong"), ("en", 2, "a", "correct"), ("de", 1, "[0-9]", "correct")])
CONSTANTS = Table("kind string, id string, value string, file string", [("amount", "fee", "$1,500", "p1.md"), ("amount", "cap", "$500", None), ("date", "day", "x", "gone.md")])
