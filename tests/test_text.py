"""Golden cases of the text operators."""

from __future__ import annotations

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planloom import queries_text
from planloom.functions import similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw",
    ["Visit https://techcorp.com/support.", "Go to www.techcorp.com now.", "Email kidshome.pin@TechCorp.com.", "See [guide](https://x.io) first."],
)
def test_scrub(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(
        text.contains_url(F.col("t")).alias("a"), text.contains_url(text.scrub(F.col("t"))).alias("b")
    ).first()
    assert row.a and not row.b


def test_casing_and_fixers(spark):
    df = spark.createDataFrame([("x",)], "t string")
    got = df.select(
        text.title_case(F.lit("force a restart")).alias("a"),
        text.title_case(F.lit("check USB and Wi-Fi")).alias("b"),
        text.build_goal(F.lit("black screen"), F.lit("Troubleshooting")).alias("c"),
        text.clean_step(F.lit("Please tap on Display")).alias("d"),
        text.clean_step(F.lit("Learn more at our website.")).alias("e"),
        text.fix_title(F.lit("Fix the screen rotation problem now"), F.lit("")).alias("f"),
        text.normalize_query(F.lit('1. "My phone\'s SCREEN!"')).alias("g"),
        text.imperative(F.lit("On devices with a Power button: Press and hold it.")).alias("h"),
        text.imperative(F.lit("If it fails, please contact support.")).alias("i"),
        text.imperative(F.lit("These steps resolve this.")).alias("j"),
    ).first()
    assert got.a == "Force a Restart" and got.b == "Check USB and Wi-Fi"
    assert got.c == "Follow these steps to perform this Black Screen Troubleshooting"
    assert got.d == "Tap on Display." and got.e is None
    assert got.f == "Fix screen rotation"
    assert got.g == "my phone s screen"
    assert got.h == "On devices with a Power button, press and hold it."
    assert got.i == "If it fails, contact support." and got.j is None


@pytest.mark.parametrize("raw", ["", "fix it", "It fixes all of the many broken screens", "Lets you choose navigation type.", "See https://a.io/b for it now"])
def test_descriptions_are_always_valid(spark, raw):
    got = one(spark, text.fix_description(F.lit(raw), F.lit("Restart Device")))
    assert got.startswith("It will ") and 5 <= len(got.split()) <= 7 and "http" not in got


@pytest.mark.parametrize("raw, topic", [("", "Display Issue"), ("Screen", "Display Issue"), ("Blank or black display on a smartphone or tablet", "x")])
def test_titles_are_always_valid(spark, raw, topic):
    assert 2 <= len(one(spark, text.fix_title(F.lit(raw), F.lit(topic))).split()) <= 3


def test_sections_and_sentences(spark):
    raw = 'Phone Title ( Phone): Intro line.\n\n## Step 1: Check it\n Tap A. Tap B.\nThen c.\n# Empty\n'
    got = one(spark, text.sections(F.lit(raw)))
    assert [(s.heading, s.body) for s in got] == [("", "Intro line."), ("Check it", "Tap A. Tap B. Then c."), ("Empty", "")]
    assert one(spark, text.sentences(F.lit('One. Two! "Three" four. five'))) == ["One.", "Two!", '"Three" four. five']


@pytest.mark.parametrize(
    "target, name, fits",
    [
        ("Super steady mode", "Easy mode", False),
        ("Factory data reset", "Auto factory reset", False),
        ("Navigation bar", "Hide status and navigation bars", False),
        ("Navigation bar", "Show input method button on navigation bar", False),
        ("Display", "Privacy display", False),
        ("Screen lock and biometrics", "Lock screen", False),
        ("Quick settings panel", "Quick Access panels", False),
        ("More", "More options", False),
        ("Navigation bar", "Navigation bar", True),
        ("Back up data", "Back up data", True),
        ("Touch sensitivity setting", "Touch sensitivity", True),
        ("Dark mode", "Dark mode settings", True),
    ],
)
def test_name_match(target, name, fits):
    got = similarity.name_match(target, name)
    assert got >= 0.6 if fits else got == 0.0


def test_ratios():
    assert round(similarity.indel_ratio("bar", "bars"), 1) == 85.7
    assert similarity.partial_ratio("abc", "xxabcxx") == 100.0
    brute = lambda s, t: max(
        similarity.indel_ratio(s, x) for x in [t[i : i + len(s)] for i in range(len(t) - len(s) + 1)] + [t[:k] for k in range(1, len(s))] + [t[-k:] for k in range(1, len(s))]
    )
    for s, t in (("tap display", "open the disply and tap it"), ("abcdefg", "gfedcbaabdefg"), ("zz", "abc")):
        assert abs(similarity.partial_ratio(s, t) - brute(s, t)) < 1e-9


def test_odd_documents_are_one_section_each_as_in_sql(spark, tmp_path, monkeypatch):
    """Headings, doubled quotes, marks, odd white space and empty texts: what only large tables have."""
    breaks = "\n \r\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
    texts = [
        "one\n# two\nthree", "## 2. only", "#", "a###\n ### b", 'say ""no"" now', '"" x', "\x01a\x02b\x03", "\x02", "\xa0nbsp\xa0\nb　", " ", "  ​",
        "", " \t\n ", None, "\n\n", breaks.join("abc"), "a \t b\t\n\t c ", "x): y (z): w", "one@two", "a\x1fb\x1f", "tail \n",
    ]
    langs = ["en", None, "", " d e ", "@", "1. x", 'f""r', "a\nb", "#"]
    rows = [(len(langs) * i + k, text, lang) for i, text in enumerate(texts) for k, lang in enumerate(langs)]
    ids, texts, langs = map(list, zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}), tmp_path / "documents.parquet")
    monkeypatch.setattr(oracle, "AT", str(tmp_path))
    oracle.assert_same_rows(spark, queries_text.split_sections, queries_text.SECTIONS_SQL)
