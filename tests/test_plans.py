"""Ordering, mapping, cache, audit and the whole flow, on golden cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from planloom.operators import audit, cache, evaluation, mapping, ordering
from planloom.operators.retrieval import usable_entries
from planloom.plans.pipeline import BagOfWords, Settings, answer
from planloom.sources import readers
from planloom.streaming.answers import answer_stream

ENTRIES = [
    ("E1", "app://nav", "Open navigation bar settings page", "View Navigation bar", "onClickURL", "Navigation bar"),
    ("E2", "app://backup", "Turn on back up", "Enable Back up data", "onURL", "Back up data (Cloud)"),
    ("E3", "app://touch_on", "Turn on touch sensitivity", "Enable Touch sensitivity", "onURL", "Touch sensitivity"),
    ("E4", "app://touch_off", "Turn off touch sensitivity", "Disable Touch sensitivity", "offURL", "Touch sensitivity"),
    ("E5", "app://accidental_off", "Turn off the protection", "Disable Accidental touch protection", "offURL", "Accidental touch protection"),
    ("E6", "app://easy", "Easy mode on the device", "Enable Easy mode", "onURL", "Easy mode"),
    ("E7", "app://tv", "TV Settings of the screen", "Open TV Settings", "onURL", "TV"),
    ("E8", "app://view", "Nothing to open", "View it", "viewURL", "View"),
    ("E9", "app://dark", "Dark theme", "Enable Dark mode", "onURL", "Dark mode"),
    ("E10", "app://timeout", "Screen timeout", "View Screen timeout", "onClickURL", "Screen timeout"),
    ("E11", "app://sound", "Sound of keys", "View Sound mode", "updateURL", "Sound mode"),
    ("E12", "app://wifi", "Wireless networks", "View Wi-Fi", "onClickURL", "Wi-Fi networks"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(i, d, desc, msg, kind, None, ("check://" + i, key)) for i, d, desc, msg, kind, key in ENTRIES]
    return spark.createDataFrame(rows, readers.LINK_ROW)


@pytest.mark.parametrize("name, want", [("Perform a Factory Data Reset", "critical"), ("Contact Customer Support", "manual"), ("Adjust Screen Orientation Settings", "auto")])
def test_categories(spark, name, want):
    steps = F.array(F.lit("Open the Quick settings panel."))
    assert spark.range(1).select(ordering.categorize(F.lit(name), steps).alias("c")).first().c == want


def test_order(spark):
    actions = [("Perform a Factory Data Reset", "critical"), ("Contact Customer Support", "manual"), ("Restart Your Device", "critical"), ("Check for Damage", "manual"), ("Adjust Screen Timeout", "auto")]
    df = spark.createDataFrame([([(n, c, ["Do it."]) for n, c in actions],)], "a array<struct<name:string,category:string,steps:array<string>>>")
    got = [r.name for r in df.select(ordering.order_actions(F.col("a")).alias("a")).first().a]
    assert got == ["Adjust Screen Timeout", "Check for Damage", "Contact Customer Support", "Restart Your Device", "Perform a Factory Data Reset"]


def test_mapping(spark, catalog):
    actions = [
        ("a1", "Configure Navigation Bar", "auto", ["Open Settings.", "Tap on Navigation bar."]),
        ("a2", "Back Up Phone Data", "auto", ["Go to Settings.", "Select Back up data."]),
        ("a3", "Increase Touch Sensitivity", "auto", ["Turn on Touch sensitivity."]),
        ("a4", "Protection Off", "auto", ["Turn off Accidental touch protection."]),
        ("a5", "Turn Off Touch Sensitivity", "auto", ["Toggle the switch next to Touch sensitivity off."]),
        ("a6", "Adjust Screen Orientation", "auto", ["Open the Quick settings panel.", "Tap the Auto rotate icon."]),
        ("a7", "Contact Customer Support", "manual", ["Contact support about Navigation bar."]),
        ("a8", "Use Super Steady Mode", "auto", ["Tap on Super steady mode."]),
    ]
    got = {r.action_id: r for r in mapping.map_actions(spark.createDataFrame(actions, "action_id string, name string, category string, steps array<string>"), usable_entries(catalog)).collect()}
    assert len(got) == len(actions)
    assert {k: got[k].chosen_id for k in got} == {"a1": "E1", "a2": "E2", "a3": "E3", "a4": "E5", "a5": "E4", "a6": None, "a7": None, "a8": None}
    assert (got["a1"].check.value, got["a2"].check.value, got["a4"].check.value, got["a5"].check.value) == (None, "True", "False", "False")
    assert got["a6"].kind == "dummy" and "Auto rotate" in got["a6"].link.message and 5 <= len(got["a6"].link.message.split()) <= 7
    assert got["a7"].link is None and got["a8"].link is None and got["a8"].category == "manual"


def _door(spark, texts):
    df = spark.createDataFrame([(p, x, n) for n, (p, x) in enumerate(texts)], "plan_id string, text string, seq long")
    from planloom.functions.text import normalize_query

    return df.select("plan_id", "text", normalize_query(F.col("text")).alias("norm"), BagOfWords().encode(F.col("text")).alias("vec"), "seq")


def test_cache_lookup(spark):
    doors = _door(spark, [("A", "my phone screen is cracked"), ("A", "broken cracked screen"), ("B", "phone does not charge")])
    plans = spark.createDataFrame([("A", "art1"), ("B", None)], "plan_id string, article string")

    def look(text, article=None, threshold=0.6, margin=0.05):
        q = spark.createDataFrame([(1, text, article)], "query_id long, text string, article string").withColumn("vec", BagOfWords().encode(F.col("text")))
        got = cache.lookup(q, plans, doors, threshold, margin).collect()
        return (got[0].match, got[0].plan_id) if got else None

    assert look("My phone screen is CRACKED!!") == ("exact", "A")
    assert look("broken cracked screen glass") == ("semantic", "A")
    assert look("battery drains overnight") is None
    assert look("My phone screen is CRACKED!!", "art2") is None and look("My phone screen is CRACKED!!", "art1") == ("exact", "A")


def test_cache_near_tie(spark):
    doors = _door(spark, [("A", "screen flickers"), ("B", "screen goes black")])
    plans = spark.createDataFrame([("A", None), ("B", None)], "plan_id string, article string")
    q = spark.createDataFrame([(1, "screen", None)], "query_id long, text string, article string").withColumn("vec", BagOfWords().encode(F.col("text")))
    assert cache.lookup(q, plans, doors, 0.3, 0.2).count() == 0


ARTICLE = """Phone Rotation ( Phone): If the screen does not rotate, try these.
## Step 1: Adjust the Screen Settings
Please open Settings. Tap on Navigation bar. Learn more at www.example.com.
## Restart the Phone
Press and hold the Power button. Then tap Restart.
"""


def test_whole_flow(spark, catalog, tmp_path):
    complaints = spark.createDataFrame(
        [(1, "My phone screen does not rotate", "Screen does not rotate on your phone", ARTICLE), (2, "My battery drains", "", None), (3, "pizza", "Screen does not rotate", ARTICLE)],
        "query_id long, query string, title string, content string",
    )
    store = readers.PlanStore(spark, f"file://{tmp_path}/store")
    first = {r.query_id: r for r in answer(complaints, catalog, store).collect()}
    assert (first[1].cache_hit, first[1].fallback, first[2].fallback, first[3].fallback) == (False, None, "no_siis_context", "no_match")
    goal = json.loads(first[1].response)["contexts"][0]
    assert [a["category"] for a in goal["actions"]] == ["auto", "manual", "critical"] and "www" not in first[1].response
    assert goal["actions"][0]["stepGroups"][0]["actionableDeeplink"]["deeplink"] == "app://nav"
    again = {r.query_id: r for r in answer(complaints, catalog, store).collect()}
    assert again[1].cache_hit and again[1].response == first[1].response and not again[2].cache_hit
    assert store.read()[0].count() == 1


def test_stream(spark, catalog, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"query_id": 1, "query": "screen does not rotate", "title": "Screen does not rotate", "content": ARTICLE}) + "\n")
    stream = spark.readStream.schema("query_id long, query string, title string, content string").json(f"{tmp_path}/in")
    store = readers.PlanStore(spark, f"file://{tmp_path}/store")
    answer_stream(stream, catalog, store, f"{tmp_path}/out", f"{tmp_path}/ck", settings=Settings()).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_each_code_fires(spark):
    from planloom.queries_plans import audit_issues

    assert {r.code for r in audit_issues(spark, "/root/testdata/sf0.01").collect()} == set(audit.CODES)


def test_reports(spark, tmp_path):
    values = spark.createDataFrame([(float(k),) for k in range(1, 21)], "v double")
    row = evaluation.latency_percentiles(values, "v").first()
    assert (row.n, row.p50, row.p95) == (20, 10.5, 19.1)
    assert "| p50 | 10.500 |" in readers.markdown_report(evaluation.latency_percentiles(values, "v"), "Latency")


def test_sources(spark, tmp_path):
    (tmp_path / "in.txt").write_text('first\n\n 1. "second"\n')
    assert [tuple(r) for r in readers.lines(spark, f"{tmp_path}/in.txt").collect()] == [(1, "first"), (2, '1. "second"')]
    (tmp_path / "c.json").write_text(json.dumps({"deeplinks": [{"id": "a", "deeplink": "x://a", "validation": {"deeplink": "x://v", "key": "K"}}, {"id": "b", "deeplink": "x://b"}]}))
    assert {r.uri for r in readers.catalog_uris(readers.catalog(spark, f"{tmp_path}/c.json")).collect()} == {"x://a", "x://v", "x://b"}
    (tmp_path / "h.json").write_text(json.dumps({"_readme": "", "items": [{"input_line": 2, "paraphrases": ["p", "q"]}]}))
    assert readers.held_out(spark, f"{tmp_path}/h.json").count() == 2
    raw = spark.createDataFrame([(None,), ("plain",), ('{"title":"t","content":"c"}',), ('{"id":1,"siis_response":{"title":"u","content":"d"}}',)], "r string")
    got = [r.a for r in raw.select(readers.to_article(F.col("r")).alias("a")).collect()]
    assert got[0] is None and tuple(got[1]) == ("", "plain") and tuple(got[2]) == ("t", "c") and tuple(got[3]) == ("u", "d")
