"""The fuzzy article join against all pairs, and how few pairs it compares."""

from __future__ import annotations

import random

from planloom.functions.similarity import sequence_ratio
from planloom.operators import pairing
from pyspark.sql import functions as F


def _edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abcxyz ") + text[at:], text[:at] + rng.choice("abcxyz ") + text[at + 1 :]])
    return text


def test_pairs_equal_those_of_all_pairs(spark):
    rng = random.Random(1)
    words = ["screen", "phone", "the", "turns", "black", "battery", "is", "not", "wifi", "a", "ab", "aaaa"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(40)]
    articles = [(t, f"t{k}", "c") for k, t in enumerate([*base, *base[:3], "", "a" * 30, "ab" * 20, "", None])]
    asked = [_edited(rng, rng.choice(base), rng.randrange(0, 9)) for _ in range(150)] + ["", None, "a" * 28, "a" * 33, "ba" * 20, "ab" * 21, "7. " + base[0].upper()]
    got = {r.i: (r.title, r.content) for r in pairing.paired(spark.createDataFrame(list(enumerate(asked)), "i long, query string"), spark.createDataFrame(articles, "original_query string, title string, content string")).collect()}
    plain = lambda t: " ".join((t or "").lower().removeprefix("7. ").split())
    held = {}
    for t, title, content in articles:
        held[plain(t)] = min(held.get(plain(t), ("~",)), (title, content))
    n = 0
    for i, query in enumerate(asked):
        if (want := held.get(plain(query))) is None:
            near = [(-r, held[t]) for t in held if (r := sequence_ratio(plain(query), t)) >= 0.9]
            want = min(near)[1] if near else (None, None)
            n += bool(near)
        assert got[i] == want, (query, got[i], want)
    assert len(got) == len(asked) and n > 30


def test_few_pairs_are_candidates(spark):
    """Texts that share a frame and differ in their cores: common trigrams pair nothing."""
    rng = random.Random(2)
    core = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30))
    held = [f"the screen of {core()} turns black" for _ in range(300)]
    asked = [t.replace("black", "blakc") for t in held] + [f"the screen of {core()} turns black" for _ in range(300)]
    pairs = pairing.candidates(spark.createDataFrame([(t,) for t in asked], "asked string"), spark.createDataFrame([(t,) for t in held], "held string")).collect()
    found = {(r.asked, r.held) for r in pairs}
    # The frame alone would pair all texts with all.
    assert found >= set(zip(asked, held, strict=False)) and len(found) < 600 * 300 / 50


def test_cuts_leave_a_gram_whole_in_every_text_of_the_ratio():
    rng = random.Random(3)
    often = {"".join(rng.choices("abcd", k=3)): rng.randrange(1, 50) for _ in range(40)}
    n = 0
    for _ in range(3000):
        b = "".join(rng.choices("abcd", k=rng.randrange(1, 45)))
        a = b
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(a) + 1)
            a = rng.choice([a[:at] + a[at + 1 :], a[:at] + rng.choice("abcd#") + a[at:], a[:at] + rng.choice("abcd#") + a[at + 1 :]])
        for least in pairing.TURNS:
            if a and sequence_ratio(a, b) >= least:
                n += 1
                assert any(b.find(a[at : at + q]) >= 0 and a.count("#", 0, at) == left and a.count("#", at + q) == right for at, q, left, right in pairing.cuts(a, least, frozenset("abcd"), often, {})), (a, b, least)
    assert n > 2000


def test_random_digits_meet_by_long_grams():
    """Trigrams of digits are in so many texts that these would meet by the square of their number."""
    rng = random.Random(4)
    digits = "0123456789abcdef"
    often = {a + b + c: 1000 for a in digits for b in digits for c in digits} | {g: 200_000 for g in (" of", "of ", "f r", " re", "red", "ed ", "d p", " pa", "par", "art")}
    after = {}
    for g, times in often.items():
        after[g[:2]] = after.get(g[:2], 0) + times
    letters = frozenset(digits + " ofredpart")
    text = "".join(rng.choices(digits, k=32)) + " of red part"
    for wrong, least, length in ((1, 0.98, 8), (2, 0.96, 6), (4, 0.92, 5), (6, 0.9, 5)):
        asked = text[:9] + "#" + text[10 : len(text) - wrong + 1] + "#" * (wrong - 1)
        made = pairing.cuts(asked, least, letters, often, after)
        assert made is not None and all(q >= length for _, q, _, _ in made), (wrong, made)
    assert pairing.cuts(text[:20] + "#" * 12 + text[32:], 0.9, letters, often, after) == []


def test_texts_bring_only_asked_grams_to_the_join(spark):
    """All grams of all held texts, with the texts, filled the disks; now those that are asked for, and few others, go without."""
    rng = random.Random(5)
    text = lambda: "".join(rng.choices("0123456789abcdef", k=32)) + " of réd 🙂 part"
    held = [text() for _ in range(400)] + ["", "ab"]
    asked = [(t[at : at + q], q) for t in held[:20] for at, q in ((3, 8), (20, 6), (len(t) - 5, 5))]
    keys = {int(pairing.gram_keys(pairing.codes_of([g]), q)[0]) for g, q in asked}
    few = spark.createDataFrame([(k, q) for k, q in zip(keys, [8, 6, 5] * len(keys), strict=False)], "key long, q int")
    of_held = spark.createDataFrame([(t,) for t in held], "held string").withColumn("bag", pairing.bag(F.col("held")))
    ids = {r.held_id: r.held for r in of_held.select(F.xxhash64("held").alias("held_id"), "held").collect()}
    found = pairing.asked_places(of_held, few, len(keys)).collect()
    met = {(ids[r.held_id], r.held_at, q) for r in found for q in (5, 6, 8) if int(pairing.gram_keys(pairing.codes_of([ids[r.held_id][r.held_at : r.held_at + q]]), q)[0:1].sum()) == r.key}
    every = {(t, at, q) for t in held for q in (5, 6, 8) for at in range(len(t) - q + 1)}
    assert met >= {(t, at, q) for t, at, q in every if (t[at : at + q], q) in set(asked)}
    # The last grams of all texts are alike; of the others next to none is asked for.
    assert len(found) == len(met) < 400 + 60 + len(every) / 50 and len(every) > 40_000
    assert "held" not in pairing.asked_places(of_held, few, len(keys)).columns
