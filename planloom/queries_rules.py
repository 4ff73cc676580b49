"""Queries of the rule fixers, steps, mapping and pairing over texts made of the driver's rows, with SQL that applies the
same rules (or, where the right answer is known from how a text was made, states that answer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .functions import wordlists as w
from .operators import cache, pairing, relational, validation
from .queries_text import _CAP, _OWN, NORM, sql_list, table
from .session import spread

# ---- SQL of the rules, for texts of ASCII characters


def _sub(x: str, pattern: str, new: str = "") -> str:
    return "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''"), new)


def _ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda v: v <> '')"


def _strip(x: str, chars: str = r"\s") -> str:
    return _sub(x, f"^[{chars}]+|[{chars}]+$")


def _join(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def _cut(x: str, junk, keep: int = 1, trimmed: str = ",.;:") -> str:
    """Without junk words at the end, but for the first `keep` words."""
    return f"{x}[1:greatest({keep}, coalesce(list_max(list_filter(range(1, len({x}) + 1), lambda i: NOT list_contains({sql_list(junk)}, trim(lower({x}[i]), '{trimmed}')))), 0))]"


def _scrub(x: str) -> str:
    for pattern in (w.MD_LINK, w.SCHEME_URL, w.WWW, w.EMAIL, w.DOMAIN):
        x = _sub(x, pattern, r"\1" if pattern == w.MD_LINK else "")
    x = _sub(x, w.DANGLING.replace("(?=[.,;:!?]|$)", "([.,;:!?]|$)"), r"\1")
    x = _sub(x, r"\s+([.,;:!?])", r"\1")
    for sign in ".,;:!?":
        x = _sub(x, rf"[{sign}]+", sign)
    return f"trim({_sub(x, r'\s{2,}', ' ')}, ' ,;:')"


def _title_case(x: str) -> str:
    return _join(
        f"list_transform({x}, lambda v, i: CASE WHEN {_OWN.format('v')} THEN v WHEN i > 1 AND i < len({x}) AND list_contains({sql_list(w.SMALL_WORDS)}, lower(v)) THEN lower(v) ELSE {_CAP.format('v')} END)"
    )


def _sentence_case(x: str) -> str:
    return _join(f"list_transform({x}, lambda v, i: CASE WHEN {_OWN.format('v')} THEN v WHEN i = 1 THEN {_CAP.format('v')} ELSE lower(v) END)")


def _chain(source: str, *steps: dict[str, str]) -> str:
    """Nested selects: each step's columns beside all that were there before."""
    for step in steps:
        source = f"SELECT *, {', '.join(f'{expression} AS {name}' for name, expression in step.items())} FROM ({source})"
    return source


# ---- titles, goals, names, descriptions


def _said(p: DataFrame) -> DataFrame:
    """Titles, names and descriptions with links, junk words, too few and too many words, as a model might write them."""
    few = F.col("p_partkey") % 4
    return p.select(
        "p_partkey",
        F.concat(F.initcap("p_name"), F.when(few == 0, F.lit(" steps: guide for your")).when(few == 1, F.concat(F.lit(" on www.x"), "p_size", F.lit(".com for the "), "p_type")).when(few == 2, F.lit("")).otherwise(F.lit(" is not responding, with USB-c and NFC"))).alias("title"),
        F.concat(F.when(few == 1, F.concat(F.lit("Step "), "p_size", F.lit(": "))).when(few == 2, F.lit("3) ")).otherwise(F.lit("")), F.lit("check the "), "p_name", F.lit(" of 'a@b.com' and "), F.lower("p_type"), F.lit("!?")).alias("name"),
        F.when(few == 0, F.lit("")).when(few == 1, F.concat(F.lit("It will open "), "p_name", F.lit("."))).when(few == 2, F.concat(F.lit("reset NFC at ."))).otherwise(F.concat(F.lit("clears the "), "p_name", F.lit(" of the cache for you and your "), F.lower("p_type"))).alias("description"),
        F.when(few == 0, F.lit("About this")).when(few == 1, F.concat(F.lit("How to clean the "), "p_name", F.lit(" or the "), F.lower("p_type"))).when(few == 2, F.lit("")).otherwise(F.concat(F.lit("Restart "), "p_name")).alias("heading"),
        F.array(F.concat(F.lit("Hold the "), "p_name", F.lit(", for 10 seconds."))).alias("steps"),
        F.concat(F.initcap("p_name"), F.when(few == 0, F.lit(" not responding on your phone")).when(few == 1, F.lit(" and display won't turn on while charging")).when(few == 2, F.lit(" setup with a TechCorp smartphone or tablet, today")).otherwise(F.lit(" using the NFC reader"))).alias("article"),
    )


_SAID_SQL = """
SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') || CASE p_partkey % 4 WHEN 0 THEN ' steps: guide for your'
    WHEN 1 THEN ' on www.x' || p_size || '.com for the ' || p_type WHEN 2 THEN '' ELSE ' is not responding, with USB-c and NFC' END AS title,
  CASE p_partkey % 4 WHEN 1 THEN 'Step ' || p_size || ': ' WHEN 2 THEN '3) ' ELSE '' END || 'check the ' || p_name || ' of ''a@b.com'' and ' || lower(p_type) || '!?' AS name,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'It will open ' || p_name || '.' WHEN 2 THEN 'reset NFC at .' ELSE 'clears the ' || p_name || ' of the cache for you and your ' || lower(p_type) END AS description,
  CASE p_partkey % 4 WHEN 0 THEN 'About this' WHEN 1 THEN 'How to clean the ' || p_name || ' or the ' || lower(p_type) WHEN 2 THEN '' ELSE 'Restart ' || p_name END AS heading,
  'Hold the ' || p_name || ', for 10 seconds.' AS step,
  list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') || CASE p_partkey % 4 WHEN 0 THEN ' not responding on your phone'
    WHEN 1 THEN ' and display won''t turn on while charging' WHEN 2 THEN ' setup with a TechCorp smartphone or tablet, today' ELSE ' using the NFC reader' END AS article
FROM part
"""


def fixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, goals, action names and descriptions after the fixers."""
    said = _said(spread(table(spark, sf_dir, "part"))).select("p_partkey", "title", "article", "name", "description", "heading")
    fixed = {
        "goal": t.build_goal(F.col("title"), F.lit("Configuration")),
        "fixed_title": t.fix_title(F.col("title"), F.col("article")),
        "fixed_name": t.fix_action_name(F.col("name")),
        "fixed_description": t.fix_description(F.col("description"), F.col("heading")),
    }
    rows = relational.once_each(said, ["title", "article", "name", "description", "heading"], fixed)
    return rows.select("p_partkey", "goal", F.col("fixed_title").alias("title"), F.col("fixed_name").alias("name"), F.col("fixed_description").alias("description"))


_TOKENS = r"[^A-Za-z0-9\- ]+"
FIXED_SQL = (
    "SELECT p_partkey, 'Follow these steps to perform this ' || coalesce(nullif("
    + _title_case("topic")
    + ", ''), 'Device') || ' Configuration' AS goal, "
    + _sentence_case("padded")
    + " AS title, coalesce(nullif("
    + _title_case("named")
    + ", ''), 'Follow Guided Steps') AS name, 'It will ' || "
    + _join(f"list_transform(shaped[1:5], lambda v: CASE WHEN {_OWN.format('v')} THEN v ELSE lower(v) END)")
    + " AS description FROM ("
    + _chain(
        _SAID_SQL,
        {"clean": _scrub("title"), "clean_name": _scrub("name"), "clean_description": _scrub("description")},
        {
            "topic_words": _ws(_sub(_sub("clean", _TOKENS, " "), r"(?i)\b(troubleshooting|configuration|guide|steps?)\b")),
            "tokens": _ws(_sub("clean", _TOKENS, " ")),
            "named": _ws(_sub(_strip(_sub(_sub("clean_name", r"(?i)^\s*(?:step\s*\d+\s*[:.)-]?|\d+[.)])\s*"), "[.:;!?]+$")), "[\"'`]+")),
            "said": _ws(_sub(_strip(_sub("clean_description", "[.!?;:]+$")), r"(?i)^it\s+will\s+")),
        },
        {
            "topic": f"({_cut('topic_words', w.TRAILING_JUNK)})[1:4]",
            "content": f"list_filter(tokens, lambda v: NOT list_contains({sql_list(w.TRAILING_JUNK)}, lower(v)))",
            "filled": f"CASE WHEN len(said) = 0 THEN ['help', 'you'] || {_ws('lower(heading)')} ELSE said END",
        },
        {"short": "CASE WHEN len(tokens) > 3 THEN (CASE WHEN len(content) >= 2 THEN content ELSE tokens END)[1:3] ELSE tokens END", "five": "filled[1:5]"},
        {"bare": _cut("short", w.TRAILING_JUNK), "kept": f"CASE WHEN len(filled) > 5 THEN {_cut("five", w.TRAILING_JUNK)} ELSE filled END"},
        {
            "more": f"(bare || list_filter({_ws('article')}, lambda v: NOT list_contains(list_transform(bare, lambda x: lower(x)), lower(v))) || ['issue', 'fix'])[1:3]",
            "shaped": "CASE WHEN len(kept) < 3 THEN kept || (['on', 'your', 'device'])[1:3 - len(kept)] ELSE kept END",
        },
        {"padded": f"CASE WHEN len(bare) < 2 THEN {_cut('more', w.TRAILING_JUNK, 2)} ELSE bare END"},
    )
    + ")"
)


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, descriptions, topics, kinds and titles that rules make of headings, steps and article titles."""
    said = _said(spread(table(spark, sf_dir, "part"))).withColumn("action", t.rule_action_name(F.col("heading"), F.col("steps")))
    said = said.withColumns({"topic": t.rule_topic(F.col("article")), "kind": t.goal_kind(F.col("article"))})
    return said.select("p_partkey", "action", t.rule_description(F.col("action")).alias("description"), "topic", "kind", t.rule_title(F.col("topic"), F.col("kind")).alias("title"))


_NONE = chr(1)  # no character that the texts have: nothing is trimmed
RULE_TEXTS_SQL = (
    "SELECT p_partkey, action, CASE WHEN NOT verb THEN 'It will explain ' WHEN len(phrase) = 4 THEN 'It will help ' ELSE 'It will help you ' END || "
    + _join("phrase")
    + " AS description, topic, kind, "
    + _join("CASE WHEN len(ends) = 2 AND kind = 'Troubleshooting' THEN ends || ['issue'] ELSE ends END")
    + " AS title FROM ("
    + _chain(
        _SAID_SQL,
        {
            "first": f"list_transform(({_ws('step')})[1:5], lambda v: {_strip('v', ',.')})",
            "cut": _sub("article", w.TOPIC_TAIL),
            "kind": f"CASE WHEN regexp_matches(article, '{w.TROUBLE.replace('(?iU)', '(?i)').replace(chr(39), chr(39) * 2)}') THEN 'Troubleshooting' ELSE 'Configuration' END",
        },
        {
            "action": f"CASE WHEN heading <> '' AND NOT regexp_matches(heading, '{w.GENERIC_HEADING.replace('(?iU)', '(?i)')}') THEN heading ELSE {_join('(' + _cut('first', w.NAME_TAIL, 2, _NONE) + ')[1:4]')} END",
            "topic_words": f"list_filter({_ws('coalesce(nullif(cut, ' + chr(39) * 2 + '), article)')}, lambda v: NOT list_contains({sql_list(w.TOPIC_DROP)}, lower(v)))",
        },
        {
            "spoken": _ws(_sub("lower(action)", r"^(how to|ways to)\s+")),
            "verb": f"list_contains({sql_list(w.IMPERATIVE_VERBS)}, lower(({_ws('action')})[1]))",
            "topic": f"coalesce(nullif({_join('topic_words')}, ''), article)",
        },
        {
            "four": f"(CASE WHEN len(spoken) > 4 THEN list_filter(spoken, lambda v: NOT list_contains({sql_list(w.DESCRIPTION_DROP)}, v)) ELSE spoken END)[1:4]",
            "plain": f"list_filter({_ws('topic')}, lambda v: NOT list_contains({sql_list([*w.AUXILIARIES, *w.TOPIC_DROP])}, lower(v)))",
        },
        {"phrase": _cut("four", w.DESCRIPTION_TAIL, 1, _NONE), "ends": "CASE WHEN len(plain) > 3 THEN plain[1:1] || plain[len(plain) - 1:] ELSE plain END"},
    )
    + ")"
)


# ---- steps and instructions


def _instructions(p: DataFrame) -> DataFrame:
    """p_partkey, said: a paragraph of sentences with numbers, fillers, links, noise, clauses and prefixes before colons."""
    return p.select(
        "p_partkey",
        F.concat(
            F.lit("1. Please then tap "), "p_name", F.lit(".  Also, go to https://x.y/z?a=1 and open "), F.initcap("p_type"), F.lit("! Click here."),
            F.lit(" Step 2: You can also check the "), "p_name", F.lit(" . If it is "), F.lower("p_type"), F.lit(", restart it. Some steps follow."),
            F.lit(" For "), "p_name", F.lit(": hold the key. There are two ways: Select "), F.lower("p_type"), F.lit(". TAP "), "p_name", F.lit(". Tap "), "p_name", F.lit("."),
        ).alias("said"),
    )


_PARAGRAPH_SQL = """SELECT p_partkey, '1. Please then tap ' || p_name || '.  Also, go to https://x.y/z?a=1 and open ' || upper(p_type[1]) || lower(p_type[2:]) || '! Click here.' ||
  ' Step 2: You can also check the ' || p_name || ' . If it is ' || lower(p_type) || ', restart it. Some steps follow.' ||
  ' For ' || p_name || ': hold the key. There are two ways: Select ' || lower(p_type) || '. TAP ' || p_name || '. Tap ' || p_name || '.' AS said FROM part"""


def cleaned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _instructions(spread(table(spark, sf_dir, "part")))
    return relational.once_each(p, ["said"], {"steps": F.array_join(t.clean_steps(F.array("said")), "|")}).select("p_partkey", "steps")


def _lead(x: str) -> str:
    for _ in range(3):
        x = _strip(_sub(x, w.LEAD_FILLER))
    return x


_NOISE = w.STEP_NOISE.replace("(?iU)", "(?i)")
STEPS_SQL = (
    "SELECT p_partkey, string_agg(done, '|' ORDER BY k) AS steps FROM ("
    + "SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(done) ORDER BY k) AS again FROM ("
    + f"SELECT p_partkey, k, CASE WHEN len({_ws('s')}) >= 2 AND NOT regexp_matches(s, '{_NOISE}') THEN upper(s[1]) || s[2:] || CASE WHEN regexp_matches(s, '[.!?]$') THEN '' ELSE '.' END END AS done FROM ("
    + _chain(
        f"SELECT p_partkey, k, parts[k] AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT p_partkey, string_split({_sub(_strip('said'), r'([.!?])\s+([A-Z])', chr(92) + '1' + chr(30) + chr(92) + '2')}, chr(30)) AS parts FROM ({_PARAGRAPH_SQL})))",
        {"bare": _strip(_sub(_scrub("part"), w.BULLET))},
        {"led": _lead("bare")},
        {"s": _strip(_sub("led", r"\s+", " "), r" \-")},
    )
    + ")) WHERE done IS NOT NULL) WHERE again = 1 GROUP BY p_partkey"
)


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules extraction takes for an instruction, by sentence."""
    p = _instructions(spread(table(spark, sf_dir, "part")))
    given = relational.once_each(p, ["said"], {"given": F.transform(t.sentences(F.col("said")), lambda s: t.imperative(s))})
    return given.select("p_partkey", F.posexplode("given").alias("k", "instruction")).select("p_partkey", F.col("k").cast("long").alias("sentence_no"), "instruction")


#: By sentence of `_instructions`: what is left of it.
INSTRUCTIONS_SQL = """
SELECT p_partkey, CAST(k - 1 AS BIGINT) AS sentence_no, [NULL, 'tap ' || p_name || '.', 'go to https://x.y/z?a=1 and open ' || upper(p_type[1]) || lower(p_type[2:]) || '!', NULL,
  'Step 2, check the ' || p_name || ' .', 'If it is ' || lower(p_type) || ', restart it.', NULL,
  'For ' || p_name || ', hold the key.', 'Select ' || lower(p_type) || '.', 'TAP ' || p_name || '.', 'Tap ' || p_name || '.'][k] AS instruction
FROM part, (SELECT unnest(range(1, 12)) AS k)
"""


# ---- mapping, articles and pairing


#: What the five steps of `queries_plans._actions` name, and where they switch.
TARGETS_SQL = """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Display' WHEN 1 THEN '' WHEN 2 THEN 'menu' WHEN 3 THEN '' ELSE 'Dark mode' END AS targets,
  CASE p_size % 5 WHEN 4 THEN 'on' ELSE '-' END AS direction FROM part
"""

#: The setting that each supplier's action was made from, switched as its number says.
MAP_SQL = """
WITH n AS (
  SELECT key, row_number() OVER (ORDER BY key) - 1 AS k, count(*) OVER () AS n FROM (
    SELECT DISTINCT list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS key FROM part WHERE p_name IS NOT NULL)
), a AS (
  SELECT s_suppkey, key, CASE WHEN s_suppkey % 2 = 0 THEN 'onURL' ELSE 'offURL' END AS kind FROM supplier JOIN n ON s_suppkey % n = k
)
SELECT s_suppkey || ':' || key AS action_id, 'catalog' AS kind, 'auto' AS category, key || ':' || kind AS chosen_id, 1.0::DOUBLE AS name_score,
  'app://' || lower(replace(key, ' ', '_')) || '/' || kind AS uri, CASE WHEN kind = 'onURL' THEN 'True' ELSE 'False' END AS value FROM a
"""


def article_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookups where complaints and plans name articles, or none: a plan serves unless both do and they differ."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("query_id", F.col("conv_id") * 100 + F.col("turn"))
    asked = c.select("query_id", "text", F.when(F.col("query_id") % 3 == 1, "a").when(F.col("query_id") % 3 == 2, "b").alias("article"))
    held = asked.select(t.plan_id(F.col("text")).alias("plan_id"), "text").distinct()
    article = F.when(F.substring("plan_id", 1, 1) < "6", "a").when(F.substring("plan_id", 1, 1) < "c", "b")
    plans = held.select("plan_id", article.alias("article")).distinct()
    doors = held.select("plan_id", t.normalize_query(F.col("text")).alias("norm"), F.lit(0).cast("long").alias("seq"))
    return cache.exact_hits(asked, plans, doors)


ARTICLE_SQL = f"""
SELECT query_id, plan_id FROM (
  SELECT query_id, substr(sha1(n), 1, 16) AS plan_id, [NULL, 'a', 'b'][1 + query_id % 3] AS asked,
    CASE WHEN substr(sha1(n), 1, 1) < '6' THEN 'a' WHEN substr(sha1(n), 1, 1) < 'c' THEN 'b' END AS held
  FROM (SELECT conv_id * 100 + turn AS query_id, {NORM.format("text")} AS n FROM conversations WHERE role = 'user')
) WHERE asked IS NULL OR held IS NULL OR asked = held
"""


def paired_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' complaints, typed as their articles have them, with some letters wrong, or about something else."""
    c = table(spark, sf_dir, "supplier").withColumn("c", F.col("s_suppkey"))
    about = F.concat(F.lit("screen "), F.md5(F.col("c").cast("string").cast("binary")), F.lit(" turns black"))
    articles = c.select(F.concat(F.lit("12. "), about).alias("original_query"), F.concat(F.lit("a"), "c").alias("title"), F.lit("x").alias("content"))
    said = F.when(F.col("c") % 3 == 0, F.upper(about)).when(F.col("c") % 3 == 1, F.regexp_replace(about, "black", "blakc")).otherwise(F.concat(F.reverse(about), F.lit(" what now")))
    return pairing.paired(c.select("s_suppkey", said.alias("query")), articles).select("s_suppkey", "title")


PAIRED_SQL = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'a' || s_suppkey END AS title FROM supplier"


def paired_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part two articles that differ in one letter, and a complaint with that letter and up to fourteen more wrong."""
    key = F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.md5(key.cast("binary")), F.lit(" of "), F.lower("p_name")).alias("about"))
    at = lambda letter: F.concat(F.substring("about", 1, 9), F.lit(letter), F.expr("substring(about, 11)"))
    articles = [p.select(at(letter).alias("original_query"), F.concat(F.lit(f"{letter}-"), "p_partkey").alias("title"), F.lit("x").alias("content")) for letter in "zy"]
    wrong = (F.col("p_partkey") % 15).cast("int")
    right = F.concat(F.expr("substring(about, 1, length(about) - p_partkey % 15)"), F.repeat(F.lit("#"), wrong))
    complaints = p.withColumn("about", right).select("p_partkey", at("#").alias("query"))
    return pairing.paired(complaints, articles[0].unionByName(articles[1])).select("p_partkey", "title")


# All but the wrong letters have partners, in both texts.
PAIRED_PARTS_SQL = """
SELECT p_partkey, CASE WHEN 1.0 - (1 + p_partkey % 15) / (36.0 + length(p_name)) >= 0.9 THEN 'y-' || p_partkey END AS title FROM part
"""


def _reply_text() -> str:
    """SQL of both engines: a reply of one plan by p_partkey, with members of right and wrong types, null or missing."""
    one_of = lambda n, *cases: "CASE p_partkey % " + str(n) + "".join(f" WHEN {k} THEN '{c}'" for k, c in enumerate(cases)) + f" ELSE '{cases[-1]}' END"
    goal = one_of(19, "7", "null", "[\"a\"]", "\"Follow these steps\"")
    score = one_of(17, "0.5", "\"0.5\"", "\"high\"", "null", "[1]", "true", "1")
    category = one_of(13, "", "\"category\":null,", "\"category\":\"often\",", "\"category\":3,", "\"category\":\"auto\",")
    steps = one_of(11, "[\"Tap.\",3]", "\"Tap.\"", "[]", "null", "[\"Tap.\",null]", "{}", "[\"Tap.\",\"Turn on.\"]")
    link = one_of(7, "null", "{\"deeplink\":\"a://b\",\"description\":\"Open\"}", "{\"deeplink\":5,\"description\":\"Open\"}", "{\"deeplink\":\"a://b\"}", "\"a://b\"", "null")
    check = one_of(5, "null", "{\"deeplink\":\"c://d\",\"key\":\"K\",\"resultType\":\"boolean\",\"condition\":\"equal\",\"value\":\"True\"}", "{\"deeplink\":\"c://d\",\"key\":\"K\",\"value\":true}", "null")
    contexts = lambda plan: f"CASE WHEN p_partkey % 23 = 0 THEN '{{}}' WHEN p_partkey % 23 = 1 THEN '{{\"contexts\":[]}}' WHEN p_partkey % 23 = 2 THEN '{{\"contexts\":null}}' WHEN p_partkey % 23 = 3 THEN '{{\"contexts\":{{}}}}' WHEN p_partkey % 23 = 4 THEN '[]' ELSE {plan} END"
    plan = (
        f"'{{\"contexts\":[{{\"goal\":' || {goal} || ',\"title\":\"' || p_name || '\",\"score\":' || {score} || ',\"more\":1,\"actions\":[{{\"actionName\":\"Adjust It\",\"description\":\"It will\",' || {category} ||"
        f" '\"stepGroups\":[{{\"steps\":' || {steps} || ',\"actionableDeeplink\":' || {link} || ',\"validationDeeplink\":' || {check} || '}}]}}]}}]}}'"
    )
    return contexts(plan)


def typed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's reply is of the right types."""
    replies = table(spark, sf_dir, "part").select("p_partkey", F.parse_json(F.expr(_reply_text())).alias("reply"))
    return replies.select("p_partkey", validation.well_typed(F.col("reply")).alias("valid"))


TYPED_SQL = f"""
WITH r AS (SELECT p_partkey, CAST({_reply_text()} AS JSON) AS j FROM part),
c AS (SELECT p_partkey, j, j -> '$.contexts[0]' AS p, j -> '$.contexts[0].actions[0]' AS a, j -> '$.contexts[0].actions[0].stepGroups[0]' AS g FROM r),
s AS (SELECT *, json_type(g, '$.actionableDeeplink') AS link, json_type(g, '$.validationDeeplink') AS check_, json_type(g, '$.steps') AS steps,
  coalesce(json_type(j, '$.contexts'), 'NULL') AS contexts FROM c)
SELECT p_partkey, json_type(j) = 'OBJECT' AND (contexts = 'NULL' OR (contexts = 'ARRAY' AND (json_array_length(j, '$.contexts') = 0 OR coalesce(
  json_type(p, '$.goal') = 'VARCHAR' AND json_type(p, '$.title') = 'VARCHAR' AND json_type(p, '$.score') NOT IN ('ARRAY', 'OBJECT', 'NULL')
  AND (json_type(p, '$.score') = 'BOOLEAN' OR try_cast(p ->> '$.score' AS DOUBLE) IS NOT NULL)
  AND (coalesce(json_type(a, '$.category'), 'NULL') = 'NULL' OR (json_type(a, '$.category') = 'VARCHAR' AND (a ->> '$.category') IN ('auto', 'manual', 'critical')))
  AND steps = 'ARRAY' AND len(list_filter(CASE WHEN steps = 'ARRAY' THEN CAST(g -> '$.steps' AS JSON[]) END, lambda x: json_type(x) <> 'VARCHAR' OR x IS NULL)) = 0
  AND (link = 'NULL' OR (link = 'OBJECT' AND json_type(g, '$.actionableDeeplink.deeplink') = 'VARCHAR' AND json_type(g, '$.actionableDeeplink.description') = 'VARCHAR'))
  AND (check_ = 'NULL' OR (check_ = 'OBJECT' AND json_type(g, '$.validationDeeplink.key') = 'VARCHAR' AND json_type(g, '$.validationDeeplink.value') = 'VARCHAR')), false)))) AS valid
FROM s
"""

#: For queries of `queries_plans`.
SQL_FOR = {"map_actions": MAP_SQL, "action_targets": TARGETS_SQL}

QUERIES = {
    "fixed_texts": (fixed_texts, FIXED_SQL),
    "rule_texts": (rule_texts, RULE_TEXTS_SQL),
    "cleaned_steps": (cleaned_steps, STEPS_SQL),
    "instructions": (instructions, INSTRUCTIONS_SQL),
    "article_rule": (article_rule, ARTICLE_SQL),
    "paired_complaints": (paired_complaints, PAIRED_SQL),
    "paired_parts": (paired_parts, PAIRED_PARTS_SQL),
    "typed_replies": (typed_replies, TYPED_SQL),
}
