"""The batch jobs: from complaints and articles to stage files, a warm cache, figures and audited samples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from planloom.plans import jobs
from planloom.plans.pipeline import answer
from planloom.sources import readers
from test_plans import ARTICLE, catalog  # noqa: F401

ASKED = [(1, "My phone screen does not rotate"), (2, "my phone screen does not rotate!"), (3, "My battery drains"), (4, "pizza")]


@pytest.fixture
def stages(spark, catalog, tmp_path):  # noqa: F811
    complaints = spark.createDataFrame(ASKED, "query_id long, query string")
    held = [("1. My phone screen does  not rotate", "Screen does not rotate on your phone", ARTICLE), ("pizza", "Screen does not rotate", ARTICLE)]
    articles = spark.createDataFrame(held, "original_query string, title string, content string")
    counted = jobs.extract_stage(complaints, articles, catalog, f"{tmp_path}/one").first()
    mapped = jobs.map_stage(catalog, f"{tmp_path}/one", f"{tmp_path}/two").first()
    return counted.asDict(), mapped.asDict(), str(tmp_path)


def test_stages_give_what_the_whole_flow_gives(spark, catalog, stages):  # noqa: F811
    counted, mapped, at = stages
    assert counted == {"rows": 4, "schema_valid": 4, "plans": 2, "clean_plans": 2}
    assert {k: mapped[k] for k in counted} == counted
    assert {k: mapped[k] for k in ("auto", "manual", "critical", "auto_linked")} == {"auto": 2, "manual": 2, "critical": 2, "auto_linked": 2}
    rows = {r.query_id: r for r in spark.read.schema(jobs.STAGE).json(f"{at}/two").collect()}
    assert [rows[k].fallback for k in (1, 2, 3, 4)] == [None, None, "no_siis_context", "no_match"] and not rows[4].response.contexts
    store = readers.PlanStore(spark, f"file://{at}/other")
    asked = spark.createDataFrame([(1, ASKED[0][1], "Screen does not rotate on your phone", ARTICLE)], "query_id long, query string, title string, content string")
    whole = json.loads(answer(asked, catalog, store).first().response)
    assert rows[1].response.asDict(recursive=True) == whole


def test_warm_serves_from_the_cache(spark, catalog, stages):  # noqa: F811
    *_, at = stages
    store = readers.PlanStore(spark, f"file://{at}/store")
    n = jobs.warm(catalog, f"{at}/two", store)
    plans, doors, _ = store.read()
    assert n == plans.count() and doors.select("seq").distinct().count() == doors.count() > 0
    assert jobs.warm(catalog, f"{at}/two", store, rebuild=True) == n and store.read()[0].count() == n
    asked = spark.createDataFrame([(9, ASKED[1][1], None, None)], "query_id long, query string, title string, content string")
    assert answer(asked, catalog, store).first().cache_hit


def test_figures_without_inputs_are_null(spark, catalog, stages):  # noqa: F811
    *_, at = stages
    cold = spark.range(1).select(F.lit(12.5).alias("p50"))
    row = jobs.figures(catalog, f"{at}/two", f"{at}/no_review.json", cold=cold, stress=None)
    got = row.first().asDict()
    assert (got["replies"], got["schema_valid"], got["without_error"], got["leaks"], got["auto_coverage"], got["validity"]) == (4, 1.0, 1.0, 0, 1.0, 1.0)
    assert got["mean_step_accuracy"] is None and got["stress"] is None and got["cold_p50"] == 12.5
    assert "| stress | n/a |" in readers.markdown_report(row, "Figures")
    with open(f"{at}/review.json", "w") as out:
        json.dump({"scores": [{"input_line": 1, "step_accuracy": 3, "deeplink_relevance": 1}, {"input_line": 2, "step_accuracy": None}]}, out)
    assert jobs.figures(catalog, f"{at}/two", f"{at}/review.json").first().mean_step_accuracy == 3.0


def test_samples(spark, catalog, tmp_path):  # noqa: F811
    link = {"deeplink": "app://nav", "description": "Open it"}
    action = {"actionName": "Open Navigation Bar", "description": "It will open the navigation bar", "category": "auto", "stepGroups": [{"steps": ["Tap on Navigation bar."], "actionableDeeplink": link}]}
    plan = {"goal": "Follow these steps to perform this Screen Rotation Troubleshooting", "title": "Screen rotation problem", "score": 0.9, "actions": [action]}
    wrong = [
        plan | {"score": "high"}, {k: v for k, v in plan.items() if k != "title"}, plan | {"actions": None}, plan | {"actions": [action | {"category": "often"}]},
        plan | {"actions": [action | {"stepGroups": [{"steps": None}]}]}, plan | {"actions": [action | {"stepGroups": [{"steps": ["Tap."], "validationDeeplink": {"deeplink": "app://nav"}}]}]},
    ]
    unknown = plan | {"actions": [action | {"stepGroups": [{"steps": ["Tap on it."], "actionableDeeplink": link | {"deeplink": "app://other"}}]}]}
    uncategorized = plan | {"actions": [{k: v for k, v in action.items() if k != "category"}]}
    for n, p in enumerate([plan, unknown, uncategorized, *wrong]):
        (tmp_path / f"s{n}.json").write_text(json.dumps({"query": "q", "response": {"contexts": [p]}}))
    (tmp_path / "t.json").write_text(json.dumps({"query": "q", "response": {}}))
    found = jobs.sample_audit(spark, f"{tmp_path}/*.json", catalog)
    rows = {r.file: r for r in found.collect()}
    assert (rows["s0.json"].passed, rows["t.json"].passed) == (True, True), rows["s0.json"]
    assert rows["s1.json"].codes == ["DEEPLINK_NOT_IN_CATALOG"] and rows["s1.json"].schema_valid and not rows["s1.json"].passed
    assert rows["s2.json"].codes == ["MANUAL_HAS_DEEPLINK"]
    assert not any(rows[f"s{n}.json"].schema_valid or rows[f"s{n}.json"].passed for n in range(3, 9))
    assert jobs.status(found, strict=True) == 1 and jobs.status(found, strict=False) == 0 == jobs.status(found.where("passed"), strict=True)
