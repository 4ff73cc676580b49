"""Replies of wrong types are refused before they are cast."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from planloom.operators import evaluation, validation
from planloom.sources import readers

LINK = {"deeplink": "app://nav", "description": "Open it"}
CHECK = {"deeplink": "check://nav", "key": "Nav", "resultType": "boolean", "condition": "equal", "value": "True"}
GROUP = {"steps": ["Tap on it."], "actionableDeeplink": LINK, "validationDeeplink": CHECK}
ACTION = {"actionName": "Open It", "description": "It will open it", "category": "auto", "stepGroups": [GROUP]}
PLAN = {"goal": "g", "title": "t", "score": 0.5, "actions": [ACTION, ACTION]}


def of(plan):
    return {"contexts": [PLAN, plan]}


def with_group(**changes):
    return of(PLAN | {"actions": [ACTION, ACTION | {"stepGroups": [GROUP, GROUP | changes]}]})


GOOD = [of(PLAN), {}, {"contexts": []}, {"contexts": None}, of(PLAN | {"score": "0.5"}), of(PLAN | {"score": 1}), of(PLAN | {"more": 3}), of(PLAN | {"actions": []}), with_group(actionableDeeplink=None), with_group(steps=[]),
        of(PLAN | {"actions": [{k: v for k, v in ACTION.items() if k != "category"}]}), with_group(validationDeeplink={"deeplink": "a", "key": "k"})]
BAD = [[], "x", 3, {"contexts": {}}, {"contexts": [3]}, of(PLAN | {"goal": 7}), of(PLAN | {"title": None}), of(PLAN | {"title": ["t"]}), of(PLAN | {"score": "high"}), of(PLAN | {"score": None}), of(PLAN | {"score": [1]}),
       of(PLAN | {"actions": None}), of(PLAN | {"actions": [ACTION | {"category": "often"}]}), of(PLAN | {"actions": [ACTION | {"category": 2}]}), of(PLAN | {"actions": [ACTION | {"description": 1.5}]}),
       with_group(steps=["Tap.", 3]), with_group(steps="Tap."), with_group(steps=[None]), with_group(actionableDeeplink="app://nav"), with_group(actionableDeeplink=LINK | {"description": True}),
       with_group(validationDeeplink=CHECK | {"value": True}), with_group(validationDeeplink=CHECK | {"condition": "like"}), with_group(validationDeeplink={"deeplink": "a"})]


def test_types_are_judged_before_the_cast(spark):
    rows = [(k, json.dumps(r), k < len(GOOD)) for k, r in enumerate([*GOOD, *BAD])]
    df = spark.createDataFrame(rows, "k long, reply string, good boolean").withColumn("v", validation.well_typed(F.parse_json("reply")))
    assert [(r.reply, r.v) for r in df.collect() if r.v != r.good] == []


@pytest.mark.parametrize(("plan", "valid"), [(PLAN, True), (PLAN | {"goal": 7}, False), (PLAN | {"title": 8}, False)])
def test_samples_keep_their_types(spark, tmp_path, plan, valid):
    (tmp_path / "a.json").write_text(json.dumps({"query": "q", "response": {"contexts": [plan]}}))
    row = readers.samples(spark, f"{tmp_path}/*.json").select("file", validation.well_typed(F.col("raw")).alias("valid"), "response").first()
    assert row.file == "a.json" and row.valid is valid and row.response.contexts[0].score == 0.5


def test_sizes(spark):
    assert evaluation.sizes(spark.range(3), spark.range(0), spark.range(5)).first().asDict() == {"plans": 3, "doors": 0, "entries": 5}
