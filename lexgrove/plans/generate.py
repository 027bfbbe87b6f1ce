"""What writes the answers: an outside service behind one function, with a recorded one for offline runs."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.live import fold_frames

_ANSWER = "answer string, tokens long, reasoning_tokens long, finish string, error string"
_COLUMNS = ["answer", "tokens", "reasoning_tokens", "finish", "error"]


class Generator(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame:
        """(qid, prompt) -> (qid, answer, tokens, finish, error)."""


class RecordedGenerator:
    """Answers from a table (qid, answer[, tokens, finish, error])."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def answer(self, prompts: DataFrame) -> DataFrame:
        have = set(self.answers.columns)
        kinds = {"tokens": "long", "finish": "string", "error": "string"} | ({"reasoning_tokens": "long"} if "reasoning_tokens" in have else {})
        extra = [F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
        return prompts.select("qid").join(self.answers.select("qid", "answer", *extra), "qid", "left")


def server_models(url: str, timeout: float = 5) -> tuple[str | None, str | None]:
    """The first model of a service that chats and the first that embeds, from its list at url; (None, None) if it can't be reached."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            ids = [m["id"] for m in json.load(r).get("data") or []]
    except (OSError, ValueError):
        return None, None
    return next((i for i in ids if "embed" not in i.lower()), None), next((i for i in ids if "embed" in i.lower()), None)


class HttpGenerator:
    """A chat-completions service that streams. Prompts are written out before, so that each is asked once. thinking: whether the model may reason first."""

    def __init__(self, url: str, model: str, system: str, max_tokens: int = 1024, temperature: float = 0.0, timeout: float = 600, thinking: bool = False):
        self.url, self.timeout, self.model, self.thinking = url, timeout, model, thinking
        self.system, self.settings = system, {"max_tokens": max_tokens, "temperature": temperature}

    def facts(self) -> dict:
        return {"model": self.model, **self.settings, "thinking": self.thinking}

    def payload(self, prompt: str) -> dict:
        body = {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], **self.settings, "stream": True, "stream_options": {"include_usage": True}}
        return body if self.thinking else body | {"reasoning_effort": "none"}

    def ask(self, prompt: str) -> dict:
        try:
            request = urllib.request.Request(self.url, json.dumps(self.payload(prompt)).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return fold_frames(x.decode("utf-8", "replace").rstrip("\n") for x in r)
        except OSError as e:
            return {"answer": None, "tokens": None, "reasoning_tokens": None, "finish": None, "error": str(e)}

    def answer(self, prompts: DataFrame) -> DataFrame:
        me = self

        def asked(batches):
            for rows in batches:
                out = [(qid, *(got[c] for c in _COLUMNS)) for qid, got in ((q, me.ask(p)) for q, p in zip(rows["qid"], rows["prompt"], strict=True))]
                yield pd.DataFrame(out, columns=["qid", *_COLUMNS]).astype({"tokens": "Int64", "reasoning_tokens": "Int64"})

        return prompts.mapInPandas(asked, f"qid long, {_ANSWER}")
