"""The language model's seam, with a scripted client: repairs, types, costs, and calls that are paid for once."""

from __future__ import annotations

import json
import os
import signal
import time
import uuid

import pytest

from planloom.operators.extraction import extract
from planloom.operators.ledger import FolderLedger, Recorded, Reply
from planloom.operators.model_extractor import ask, example, model_extractor, parse_plan

ARTICLE = "Quiet calls\n## Raise the Volume\nPress the volume key during a call. Turn off Do not disturb in Settings."
PLAN = {
    "relevance": 0.75, "topic": "call volume", "goal_kind": "Configuration", "title": "How to make every call louder",
    "query_variations": ["calls too quiet", "Calls Too Quiet", "ask at www.volume.example now"],
    "actions": [{"name": "raise the volume", "description": "louder", "steps": ["Press the volume key during a call.", "Write to help@volume.example please.", "Buy a second battery pack."]}],
}
GOOD = json.dumps(PLAN)


def answering(*replies):
    """A factory of clients that give these replies in turn, the last one for good. The class is made here, to travel by value."""

    class Answering:
        def __init__(self):
            self.asked = []

        def complete_json(self, system, messages):
            self.asked.append(messages)
            return Reply(replies[min(len(self.asked), len(replies)) - 1], 40 + len(messages), 7, 0.25)

    return Answering


def test_a_reply_is_repaired_twice_at_most():
    client = answering("no json at all", f"```json\n{GOOD}\n```")()
    plan, used = ask(client, "q", "t", "c")
    assert json.loads(plan)["title"] == PLAN["title"] and [len(m) for m in client.asked] == [3, 5]
    assert (used.prompt_tokens, used.completion_tokens, used.cost_usd) == (43 + 45, 14, 0.5)
    client = answering("[1]")()
    plan, used = ask(client, "q", "t", "c")
    assert plan is None and len(client.asked) == 3 and "JSON object" in used.text and used.completion_tokens == 21


def test_each_request_follows_the_example():
    client = answering(GOOD)()
    ask(client, "quiet calls", "T", "C")
    first, second, third = client.asked[0]
    assert [first, second] == example() and first["role"] == "user" and third["content"].startswith("Complaint:\nquiet calls")
    wanted = parse_plan(second["content"])
    assert all(step in first["content"] or step.rstrip(".").lower() in first["content"].lower() for a in wanted["actions"] for step in a["steps"])


@pytest.mark.parametrize(
    "wrong",
    [{"title": 5}, {"topic": ["a"]}, {"no_match": "no"}, {"query_variations": "one"}, {"query_variations": [1]}, {"actions": {}}, {"actions": [{"name": 3, "steps": []}]},
     {"actions": [{"name": "a", "steps": ["b", 4]}]}, {"actions": [{"name": "a", "steps": [], "description": 1}]}, {"relevance": 1.5}, {"relevance": "much"}, {"goal_kind": "Other"}],
)
def test_wrong_types_are_no_plan(wrong):
    with pytest.raises((ValueError, TypeError)):
        parse_plan(json.dumps(PLAN | wrong))
    assert parse_plan(json.dumps(PLAN | {"normalized_query": None}))["no_match"] is False


def _complaints(spark, n):
    rows = [(k, f"calls are quiet {k}", "Quiet calls", ARTICLE) for k in range(n)] + [(n, "x", "", None)]
    return spark.createDataFrame(rows, "query_id long, query string, title string, content string").coalesce(1)


def test_flow_with_a_model(spark):
    got = {r.query_id: r for r in extract(_complaints(spark, 1), model_extractor(answering(GOOD)), "llm").collect()}
    assert got[0].fallback is None and 2 <= len(got[0].plan_title.split()) <= 3 and (got[0].prompt_tokens, got[0].cost_usd) == (43, 0.25)
    assert [a.steps for a in got[0].actions] == [["Press the volume key during a call."]]
    assert got[0].query_variations[0] == "calls too quiet" and len(got[0].query_variations) == 2
    assert got[1].fallback == "no_siis_context" and got[1].prompt_tokens == 0
    failed = extract(_complaints(spark, 1), model_extractor(answering("?")), "llm").where("query_id = 0").first()
    assert failed.fallback == "extraction_error"


def counting(folder, dies_at=None):
    """Clients that leave a file for each call, and end their task's process in the midst of one if so many are there."""

    class Counting:
        name = "counting"

        def complete_json(self, system, messages):
            if dies_at is not None and len(os.listdir(folder)) >= dies_at:
                os.kill(os.getpid(), signal.SIGKILL)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(messages[-1]["content"])
            return Reply(GOOD, 30, 5, 0.5)

    return Counting


def test_a_lost_task_pays_nothing_twice(spark, tmp_path):
    """A task's process is killed after half of its calls; run again, it makes the other half, and costs count once."""
    (tmp_path / "calls").mkdir()
    calls, ledger, n = str(tmp_path / "calls"), FolderLedger(f"file://{tmp_path}/ledger"), 20
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        extract(_complaints(spark, n), model_extractor(counting(calls, n // 2), ledger), "llm").collect()
    assert len(os.listdir(calls)) == n // 2
    rows = extract(_complaints(spark, n), model_extractor(counting(calls), ledger), "llm").collect()
    asked = [open(f"{calls}/{name}").read() for name in os.listdir(calls)]
    assert len(asked) == n == len(set(asked))
    assert sum(r.cost_usd for r in rows) == 0.5 * n and sum(r.fallback is None for r in rows) == n
    again = extract(_complaints(spark, n), model_extractor(counting(calls), ledger, in_flight=4), "llm").collect()
    assert len(os.listdir(calls)) == n and sorted(map(str, again)) == sorted(map(str, rows))


def test_clients_of_other_names_do_not_share_replies(tmp_path):
    ledger = FolderLedger(f"file://{tmp_path}/ledger")
    one, two = answering("a")(), answering("b")()
    one.name, two.name = "one", "two"
    messages = [{"role": "user", "content": "é"}]
    assert [Recorded(c, ledger).complete_json("s", messages).text for c in (one, two, one, two)] == ["a", "b", "a", "b"]
    assert len(one.asked) == len(two.asked) == 1


def test_calls_in_flight_are_bounded(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        class Slow:
            def complete_json(self, system, messages):
                mine = f"{folder}/open-{uuid.uuid4().hex}"
                open(mine, "w").close()
                n = sum(name.startswith("open-") for name in os.listdir(folder))
                open(f"{folder}/seen-{n}", "w").close()
                time.sleep(0.1)
                os.remove(mine)
                return Reply(GOOD)

        return Slow

    assert extract(_complaints(spark, 12), model_extractor(make(), in_flight=3), "llm").where("fallback IS NULL").count() == 12
    assert 2 <= max(int(name[5:]) for name in os.listdir(folder)) <= 3
