"""A language model as extractor: the caller's client is called once a complaint, within the task that has the row.

A client has complete_json(system, messages) -> Reply. It is built once a task by the factory that is passed in, so
that nothing of it travels but the factory. A reply that is no valid plan goes back to the model with what is wrong,
twice at most; after that the row gets no plan, which the flow answers with extraction_error. Nothing raises.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wordlists as w
from .extraction import RAW_PLAN, Extractor
from .ledger import Ledger, Recorded, Reply

MAX_REPAIRS = 2
ERROR_CHARS = 800
SYSTEM = (
    "Read a complaint and a help article, and answer with one JSON object: no_match (boolean), relevance (0 to 1), topic, "
    "goal_kind (Troubleshooting or Configuration), title, normalized_query, query_variations (8 to 10 strings) and actions, "
    "a list of {name, description, steps}. Take every step from the article, one interaction each, without any address."
)


class Client(Protocol):
    def complete_json(self, system: str, messages: list[dict[str, str]]) -> Reply: ...


def _texts(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(y, str) for y in x)


def parse_plan(text: str) -> dict[str, Any]:
    """A plan from a reply, code fences allowed around it. ValueError says what is wrong; nothing is read as another type."""
    plan = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text))
    if not isinstance(plan, dict):
        raise ValueError("the reply is no JSON object")
    if plan.get("goal_kind", w.GOAL_KINDS[0]) not in w.GOAL_KINDS:
        raise ValueError(f"goal_kind has to be one of {', '.join(w.GOAL_KINDS)}")
    if not 0 <= float(plan.get("relevance", 0.8)) <= 1:
        raise ValueError("relevance has to be between 0 and 1")
    if not isinstance(plan.get("no_match", False), bool):
        raise ValueError("no_match has to be true or false")
    for name in ("topic", "title", "normalized_query"):
        if not isinstance(plan.get(name, ""), str) and not (name == "normalized_query" and plan[name] is None):
            raise ValueError(f"{name} has to be a text")
    if not _texts(plan.get("query_variations", [])):
        raise ValueError("query_variations has to be a list of texts")
    if not isinstance(plan.get("actions", []), list):
        raise ValueError("actions has to be a list")
    for action in plan.get("actions", []):
        named = isinstance(action, dict) and isinstance(action.get("name"), str) and isinstance(action.get("description", ""), str)
        if not (named and _texts(action.get("steps"))):
            raise ValueError("every action needs a name and a list of steps, all of them texts")
    filled = {"no_match": False, "relevance": 0.8, "topic": "", "goal_kind": w.GOAL_KINDS[0], "title": "", "normalized_query": None}
    return filled | {"query_variations": [], "actions": []} | plan


def request(query: str, title: str, content: str) -> str:
    return f"Complaint:\n{query}\n\nArticle: {title}\n{content}"


def example() -> list[dict[str, str]]:
    """A complaint with its article, and the plan that is wanted for it: what the model sees before each request."""
    article = "Sound from the left speaker only\nDust can block a speaker. Brush the openings with a dry cloth. Then open Settings and tap on Sound balance. Move the slider to the middle."
    title, _, content = article.partition("\n")
    plan = {
        "no_match": False, "relevance": 0.9, "topic": "Sound Balance", "goal_kind": "Troubleshooting", "title": "Uneven sound fix", "normalized_query": "right speaker has no sound",
        "query_variations": ["one speaker is silent", "no sound on the right side", "sound only left??", "why is my right speaker dead", "speaker right not working", "audio comes from one side", "half the sound is gone", "rigth speaker silent"],
        "actions": [
            {"name": "Clean the Speaker", "description": "It will clear the speaker openings", "steps": ["Brush the openings with a dry cloth."]},
            {"name": "Center the Sound Balance", "description": "It will even out both sides", "steps": ["Open Settings.", "Tap on Sound balance.", "Move the slider to the middle."]},
        ],
    }
    return [{"role": "user", "content": request("my right speaker is dead", title, content)}, {"role": "assistant", "content": json.dumps(plan)}]


def ask(client: Client, query: str, title: str, content: str) -> tuple[str | None, Reply]:
    """(plan as JSON, or None; what all calls cost together, with the last error as text)."""
    messages = [*example(), {"role": "user", "content": request(query, title, content)}]
    tokens_in, tokens_out, cost, error = 0, 0, 0.0, ""
    for _ in range(1 + MAX_REPAIRS):
        try:
            reply = client.complete_json(SYSTEM, messages)
        except Exception as wrong:  # whatever the client's own failure is, it ends this row only
            return None, Reply(str(wrong)[:ERROR_CHARS], tokens_in, tokens_out, cost)
        tokens_in, tokens_out, cost = tokens_in + reply.prompt_tokens, tokens_out + reply.completion_tokens, cost + reply.cost_usd
        try:
            return json.dumps(parse_plan(reply.text), ensure_ascii=False), Reply("", tokens_in, tokens_out, cost)
        except (ValueError, TypeError) as wrong:
            error = str(wrong)[:ERROR_CHARS]
        complaint = f"That was not valid: {error}. Answer with the JSON object alone."
        messages = [*messages, {"role": "assistant", "content": reply.text}, {"role": "user", "content": complaint}]
    return None, Reply(error, tokens_in, tokens_out, cost)


def model_extractor(client_factory: Callable[[], Client], ledger: Ledger | None = None, in_flight: int = 1) -> Extractor:
    """An extractor for extract(..., kind="llm"); it also adds prompt_tokens, completion_tokens, cost_usd and error.

    ledger: where replies are recorded, so that a task that runs again pays for none twice. in_flight: how many calls a
    task has open at most; each has a client of its own.
    """

    def make() -> Client:
        return Recorded(client_factory(), ledger) if ledger is not None else client_factory()

    def extractor(complaints: DataFrame) -> DataFrame:
        added = "_raw string, prompt_tokens long, completion_tokens long, cost_usd double, error string"
        schema = T.StructType([*complaints.schema.fields, *T.StructType.fromDDL(added).fields])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = threading.local()

            def one(row: tuple[str, str | None, str | None]) -> tuple[str | None, Reply]:
                query, title, content = row
                if not content:  # complaints without an article are answered without a call
                    return None, Reply("")
                if not hasattr(mine, "client"):
                    mine.client = make()
                return ask(mine.client, query, title or "", content)

            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    got = list(pool.map(one, zip(batch["query"], batch["title"], batch["content"], strict=True)))
                    yield batch.assign(
                        _raw=[plan for plan, _ in got], prompt_tokens=[r.prompt_tokens for _, r in got], completion_tokens=[r.completion_tokens for _, r in got],
                        cost_usd=[r.cost_usd for _, r in got], error=[r.text for _, r in got],
                    )

        asked = complaints.mapInPandas(run, schema)
        return asked.withColumn("raw", F.from_json("_raw", RAW_PLAN.replace("\n", " "))).drop("_raw")

    return extractor
