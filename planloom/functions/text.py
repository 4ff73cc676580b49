"""Text operators as Column expressions: cleaning, casing, rule fixers, tokens. Null texts stay null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as w

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\"'])"
STEP_END = r"(?<=[.!?])\s+(?=[A-Z])"
#: Marks for section headings and line ends inside a text that is being cut up; texts lose them beforehand.
_HEAD, _BODY, _LINE = "\x01", "\x02", "\x03"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: What (?U)\\s matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column, characters: str = r"\s") -> Column:
    if characters == r"\s":
        return F.btrim(text, F.lit(WHITE_SPACE))
    return F.regexp_replace(text, f"(?U)^[{characters}]+|[{characters}]+$", "")


def words(text: Column) -> Column:
    """Non-empty words between white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def is_in(text: Column, values: Sequence[str]) -> Column:
    return text.isin(sorted(set(values)))


# ---- links and other noise


#: Each pattern with a cheap test that every text with a match passes, so that most texts skip the costly search.
_LINKS = (
    (w.MD_LINK, lambda x: x.contains("](")),
    (w.SCHEME_URL, lambda x: x.contains("://")),
    (w.WWW, lambda x: F.lower(x).contains("www.")),
    (w.EMAIL, lambda x: x.contains("@")),
    (w.DOMAIN, lambda x: x.rlike(rf"(?iu)\.(?:{w.TLDS})")),
)


def contains_url(text: Column) -> Column:
    found = F.lit(False)
    for pattern, gate in _LINKS:
        found = found | (gate(text) & text.rlike(pattern))
    return F.coalesce(found, F.lit(False))


#: A word that DANGLING takes, before a sign or the end; white space as (?U) has it.
_DANGLES = rf"(?iu)(?:visit|see|at|to)[{WHITE_SPACE}]*(?:[.,;:!?]|$)"


#: What the three replacements after it look for; where none is found, none of them changes anything.
_UNTIDY = rf"[{WHITE_SPACE}][{WHITE_SPACE}.,;:!?]|([.,;:!?])\1"


def _gated(text: Column, gate: Callable[[Column], Column], pattern: str, new: str) -> Column:
    return let(text, lambda x: F.when(gate(x), F.regexp_replace(x, pattern, new)).otherwise(x))


def scrub(text: Column) -> Column:
    """Without links, mail addresses and domains, nor the words and signs that they leave dangling."""
    out = text
    for pattern, gate in _LINKS:
        out = _gated(out, gate, pattern, "$1" if pattern == w.MD_LINK else "")
    out = _gated(out, lambda x: x.rlike(_DANGLES), w.DANGLING, "")

    def tidied(x: Column) -> Column:
        out = F.regexp_replace(x, r"(?U)\s+([.,;:!?])", "$1")
        out = F.regexp_replace(out, r"([.,;:!?])\1+", "$1")
        return F.when(x.rlike(_UNTIDY), F.regexp_replace(out, r"(?U)\s{2,}", " ")).otherwise(x)

    return strip(let(out, tidied), " ,;:")


def strip_header(content: Column) -> Column:
    """Without the category header that ends in "): " within the first 400 characters."""
    at = F.instr(content, "): ")
    has_header = at.between(2, 400) & (F.instr(F.substring(content, F.lit(1), at - 1), "(") > 0)
    return F.when(has_header, F.substring(content, at + 3, F.length(content))).otherwise(content)


def clean_article(content: Column) -> Column:
    out = F.replace(strip_header(F.coalesce(content, F.lit(""))), F.lit('""'), F.lit(" "))
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def sections(content: Column) -> Column:
    """Array of (heading, body); lines before the first heading have an empty one. Nothing is shuffled for it."""
    lines = F.split(F.translate(clean_article(content), _HEAD + _BODY + _LINE, ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    lines = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    heading = lambda x: strip(F.regexp_replace(F.regexp_extract(x, w.HEADING, 1), w.STEP_PREFIX, ""))
    marked = F.transform(
        lines, lambda x: F.when(x.rlike(w.HEADING), F.concat(F.lit(_HEAD), heading(x), F.lit(_BODY))).otherwise(F.concat(x, F.lit(_LINE)))
    )
    parts = F.split(F.concat(F.lit(_BODY), F.array_join(marked, "")), _HEAD)
    body = lambda p: F.rtrim(F.replace(F.substring_index(p, _BODY, -1), F.lit(_LINE), F.lit(" ")))
    out = F.transform(parts, lambda p: F.struct(F.substring_index(p, _BODY, 1).alias("heading"), body(p).alias("body")))
    return F.filter(out, lambda s: (s["heading"] != "") | (s["body"] != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda x: strip(x)), lambda x: x != "")


def split_step(step: Column) -> Column:
    return F.filter(F.split(strip(F.coalesce(step, F.lit(""))), STEP_END), lambda x: strip(x) != "")


def clean_step(step: Column) -> Column:
    """One tidy instruction with a full stop, or null for noise and for less than two words."""

    def finish(s: Column) -> Column:
        capital = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
        ended = F.when(capital.rlike(r"[.!?]$"), capital).otherwise(F.concat(capital, F.lit(".")))
        # Parts of what STEP_NOISE takes, of letters that no other letters pass for where case doesn't count.
        noisy = let(F.lower(s), lambda x: x.contains("more") | x.contains(" here") | x.contains("web") | x.contains("ne at"))
        # Single spaces, and none at the ends: one within means two words.
        return F.when(s.contains(" ") & ~(noisy & s.rlike(w.STEP_NOISE)), ended)

    def led(s: Column) -> Column:
        bare = s
        for _ in range(3):
            bare = strip(F.regexp_replace(bare, w.LEAD_FILLER, ""))
        return F.when(s.rlike(w.LEAD_FILLER), bare).otherwise(s)

    s = let(strip(F.regexp_replace(scrub(F.coalesce(step, F.lit(""))), w.BULLET, "")), led)
    return let(strip(F.regexp_replace(s, r"(?U)\s+", " "), r" \-"), finish)


def first_of_each(texts: Column) -> Column:
    """Without later texts that differ from an earlier one in case only. Sorted, so that long lists take no square of their length."""
    placed = F.transform(texts, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))
    first = lambda every: F.filter(every, lambda e, k: e["low"].isNotNull() & ((k == 0) | ~e["low"].eqNullSafe(F.get(every, k - 1)["low"])))
    back = lambda every: F.sort_array(F.transform(every, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back(let(F.sort_array(placed), first)), lambda e: e["x"])


def clean_steps(steps: Column) -> Column:
    cleaned = F.transform(F.flatten(F.transform(steps, split_step)), clean_step)
    return let(F.filter(cleaned, lambda x: x.isNotNull()), first_of_each)


def normalize_query(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s*\d+\.\s*", "")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def plan_id(query: Column) -> Column:
    return F.substring(F.sha1(normalize_query(query).cast("binary")), 1, 16)


def article_hash(title: Column, content: Column) -> Column:
    """Null for an article without text."""
    body = strip(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    return F.when(body != "", F.substring(F.sha1(body.cast("binary")), 1, 16))


# ---- casing


def keeps_own_case(word: Column) -> Column:
    """Acronyms and brand-like words: a capital after the first letter."""
    return F.regexp_replace(word, "[^A-Za-z]", "").rlike("^.+[A-Z]")


def capitalize(word: Column) -> Column:
    """A capital at the start of each part between hyphens."""
    return F.array_join(F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "-")


def title_case(text: Column) -> Column:
    def cased(tokens: Column) -> Column:
        inner = lambda i: (i > 0) & (i < F.size(tokens) - 1)
        return F.transform(
            tokens,
            lambda t, i: F.when(keeps_own_case(t), t)
            .when(inner(i) & is_in(F.lower(t), w.SMALL_WORDS), F.lower(t))
            .otherwise(capitalize(F.lower(t))),
        )

    return joined(let(words(F.regexp_replace(text, "[\"'`]+", "")), cased))


def sentence_case(text: Column) -> Column:
    cased = lambda t, i: F.when(keeps_own_case(t), t).when(i == 0, capitalize(F.lower(t))).otherwise(F.lower(t))
    return joined(F.transform(words(text), cased))


# ---- rule fixers: each gives a value that the audit accepts


def strip_trailing(tokens: Column, junk: Sequence[str], keep: int = 1, trimmed: str = ",.;:") -> Column:
    """Without junk words at the end, but for the first `keep` words."""

    def cut(t: Column) -> Column:
        good = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i > 0) & ~is_in(strip(F.lower(F.get(t, i - 1)), trimmed), junk))
        return F.slice(t, F.lit(1), F.greatest(F.lit(keep), F.coalesce(F.array_max(good), F.lit(0))))

    return let(tokens, cut)


def clean_topic(topic: Column) -> Column:
    out = F.regexp_replace(scrub(F.coalesce(topic, F.lit(""))), r"[^A-Za-z0-9\- ]+", " ")
    out = F.regexp_replace(out, r"(?iU)\b(troubleshooting|configuration|guide|steps?)\b", "")
    cased = title_case(joined(F.slice(strip_trailing(words(out), w.TRAILING_JUNK), 1, w.TOPIC_WORDS)))
    return let(cased, lambda t: F.when(t == "", "Device").otherwise(t))


def build_goal(topic: Column, kind: Column) -> Column:
    kind = F.when(kind.isin(*w.GOAL_KINDS), kind).otherwise(w.GOAL_KINDS[0])
    return F.concat(F.lit("Follow these steps to perform this "), clean_topic(topic), F.lit(" "), kind)


def fix_title(title: Column, fallback_topic: Column) -> Column:
    """Two or three words in sentence case."""
    least, most = w.TITLE_WORDS

    def shortened(tokens: Column) -> Column:
        content = F.filter(tokens, lambda t: ~is_in(F.lower(t), w.TRAILING_JUNK))
        cut = F.slice(F.when(F.size(content) >= least, content).otherwise(tokens), 1, most)
        return F.when(F.size(tokens) > most, cut).otherwise(tokens)

    def padded(tokens: Column) -> Column:
        low = F.transform(tokens, F.lower)
        extra = F.filter(words(fallback_topic), lambda t: ~F.array_contains(low, F.lower(t)))
        more = F.slice(F.concat(tokens, extra, F.array(F.lit("issue"), F.lit("fix"))), 1, most)
        return F.when(F.size(tokens) < least, strip_trailing(more, w.TRAILING_JUNK, least)).otherwise(tokens)

    tokens = words(F.regexp_replace(scrub(F.coalesce(title, F.lit(""))), r"[^A-Za-z0-9\- ]+", " "))
    return sentence_case(joined(let(strip_trailing(let(tokens, shortened), w.TRAILING_JUNK), padded)))


def fix_action_name(name: Column) -> Column:
    out = F.regexp_replace(scrub(F.coalesce(name, F.lit(""))), r"(?iU)^\s*(?:step\s*\d+\s*[:.)-]?|\d+[.)])\s*", "")
    cased = title_case(strip(F.regexp_replace(out, "[.:;!?]+$", "")))
    return let(cased, lambda t: F.when(t == "", "Follow Guided Steps").otherwise(t))


def fix_description(description: Column, action_name: Column) -> Column:
    """Five to seven words that start with "It will"."""
    least, most = (n - 2 for n in w.DESCRIPTION_WORDS)
    body = strip(F.regexp_replace(scrub(F.coalesce(description, F.lit(""))), "[.!?;:]+$", ""))
    tokens = words(F.regexp_replace(body, r"(?iU)^it\s+will\s+", ""))
    instead = F.concat(F.array(F.lit("help"), F.lit("you")), words(F.lower(F.coalesce(action_name, F.lit("")))))

    def shaped(t: Column) -> Column:
        cut = F.when(F.size(t) > most, strip_trailing(F.slice(t, 1, most), w.TRAILING_JUNK)).otherwise(t)
        pad = F.array(F.lit("on"), F.lit("your"), F.lit("device"))
        return let(cut, lambda c: F.when(F.size(c) < least, F.concat(c, F.slice(pad, F.lit(1), least - F.size(c)))).otherwise(c))

    shape = let(let(tokens, lambda t: F.when(F.size(t) == 0, instead).otherwise(t)), shaped)
    lowered = F.transform(F.slice(shape, 1, most), lambda t: F.when(keeps_own_case(t), t).otherwise(F.lower(t)))
    return F.concat(F.lit("It will "), joined(lowered))


def clamp_score(score: Column) -> Column:
    """Between 0 and 1, to two places; 0.5 for what is no number."""
    return F.coalesce(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score.try_cast("double"))), 2), F.lit(0.5))


# ---- tokens


def tokenize(text: Column) -> Column:
    """Index tokens: letters and digits in lower case, without stop words and single characters, repeats kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~is_in(t, w.INDEX_STOPWORDS) & (F.length(t) > 1))


def stem(token: Column) -> Column:
    out = token
    for suffix in reversed(("ing", "ed", "es", "s")):
        fits = token.endswith(suffix) & (F.length(token) > len(suffix) + 3)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def content_tokens(text: Column) -> Column:
    """The set of stems that carry a step's meaning."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(found, lambda t: ~is_in(t, [*w.STOPWORDS, *w.UI_WORDS]) & (F.length(t) > 1))
    return F.array_distinct(F.transform(kept, stem))


def overlap(tokens: Column, source: Column, empty: float) -> Column:
    """Share of a token set that a source has; `empty` for an empty set."""
    share = F.size(F.array_intersect(tokens, source)) / F.nullif(F.size(tokens), F.lit(0))
    return F.coalesce(share, F.lit(empty))


# ---- rules extraction


def _strip_front(text: Column) -> Column:
    def cut(x: Column) -> Column:
        bare = x
        for _ in range(3):
            bare = F.regexp_replace(F.regexp_replace(bare, w.FILLER, ""), w.YOU_CAN, "")
        return F.when(x.rlike(f"{w.FILLER}|{w.YOU_CAN}"), bare).otherwise(x)

    return strip(let(text, cut))


def _first_word(text: Column) -> Column:
    return strip(F.lower(F.coalesce(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1), F.lit(""))), ",.:")


def imperative(sentence: Column) -> Column:
    """The instruction that a sentence gives, or null. What follows a colon is looked at first, however many there are."""

    def plain(s: Column) -> Column:
        main = lambda c: _strip_front(F.substring(s, F.length(c) + 1, F.length(s)))
        behind = lambda c: let(main(c), lambda m: F.when(is_in(_first_word(m), w.IMPERATIVE_VERBS), F.concat(c, m)))
        after = let(F.regexp_extract(s, w.LEADING_CLAUSE, 0), lambda c: F.when(c != "", behind(c)))
        given = F.when(is_in(_first_word(s), w.IMPERATIVE_VERBS), s).otherwise(after)
        # The costly search only where there is something to refuse.
        return let(given, lambda x: F.when(x.isNotNull() & ~s.rlike(w.META), x))

    front = lambda x: _strip_front(strip(x))
    level = lambda prefix, s: F.struct(prefix.alias("prefix"), s.alias("s"))

    def behind_colon(levels: Column, _: Column) -> Column:
        def cut(s: Column) -> Column:
            at = F.instr(s, ":")
            rest = strip(F.substring(s, at + 1, F.length(s)))
            more = F.concat(levels, F.array(level(F.substring(s, F.lit(1), at - 1), front(rest))))
            return F.when(at.between(1, 80) & (rest != ""), more).otherwise(levels)

        return let(F.element_at(levels, -1)["s"], cut)

    def with_prefix(prefix: Column, found: Column) -> Column:
        alone = prefix.rlike(w.META) | (F.size(words(prefix)) > 10) | prefix.rlike(r"(?iU)^there (are|is)\b")
        lowered = F.concat(strip(prefix), F.lit(", "), F.lower(F.substring(found, 1, 1)), F.substring(found, 2, 1 << 30))
        return F.when(alone, found).otherwise(lowered)

    # found: what the level behind gives; prefix: what stands before that level's colon.
    state = lambda found, prefix: F.struct(found.cast("string").alias("found"), prefix.cast("string").alias("prefix"))
    outward = lambda acc, x: state(F.coalesce(F.when(acc["found"].isNotNull(), with_prefix(acc["prefix"], acc["found"])), plain(x["s"])), x["prefix"])
    colons = F.size(F.split(sentence, ":")) - 1
    places = F.when(colons > 0, F.sequence(F.lit(1), F.greatest(colons, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(places, F.array(level(F.lit(""), front(sentence))), behind_colon)
    return F.aggregate(F.reverse(levels), state(F.lit(None), F.lit(None)), outward, lambda acc: acc["found"])


def rule_action_name(heading: Column, steps: Column) -> Column:
    first = F.transform(F.slice(words(F.get(steps, F.lit(0))), 1, 5), lambda t: strip(t, ",."))
    from_step = joined(F.slice(strip_trailing(first, w.NAME_TAIL, 2, r"\x00"), 1, 4))
    return F.when((heading != "") & ~heading.rlike(w.GENERIC_HEADING), heading).otherwise(from_step)


def rule_description(action_name: Column) -> Column:
    def phrase(tokens: Column) -> Column:
        short = F.when(F.size(tokens) > 4, F.filter(tokens, lambda t: ~is_in(t, w.DESCRIPTION_DROP))).otherwise(tokens)
        return joined(strip_trailing(F.slice(short, 1, 4), w.DESCRIPTION_TAIL, 1, r"\x00"))

    named = let(words(F.regexp_replace(F.lower(action_name), r"^(how to|ways to)\s+", "")), phrase)
    verb = is_in(F.lower(F.coalesce(F.get(words(action_name), F.lit(0)), F.lit(""))), w.IMPERATIVE_VERBS)
    start = lambda p: F.when(~verb, "It will explain ").when(F.size(words(p)) == 4, "It will help ").otherwise("It will help you ")
    return let(named, lambda p: F.concat(start(p), p))


def rule_topic(title: Column) -> Column:
    cut = F.regexp_replace(title, w.TOPIC_TAIL, "")
    kept = joined(F.filter(words(F.when(cut == "", title).otherwise(cut)), lambda t: ~is_in(F.lower(t), w.TOPIC_DROP)))
    return let(kept, lambda t: F.when(t == "", title).otherwise(t))


def goal_kind(title: Column) -> Column:
    return F.when(title.rlike(w.TROUBLE), w.GOAL_KINDS[0]).otherwise(w.GOAL_KINDS[1])


def rule_title(topic: Column, kind: Column) -> Column:
    def shaped(t: Column) -> Column:
        ends = F.when(F.size(t) > 3, F.concat(F.slice(t, 1, 1), F.slice(t, -2, 2))).otherwise(t)
        return let(ends, lambda e: F.when((F.size(e) == 2) & (kind == w.GOAL_KINDS[0]), F.concat(e, F.array(F.lit("issue")))).otherwise(e))

    return joined(let(F.filter(words(topic), lambda t: ~is_in(F.lower(t), [*w.AUXILIARIES, *w.TOPIC_DROP])), shaped))
