r"""Chat formatting (4) by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and that reply alone under the
loss mask. Turns after the last reply (or a conversation without any) end in one example without a target, so that no
turn is lost. A turn is written ``<turn ROLE>TEXT</turn>`` and a line feed; inside role and text ``\`` becomes ``\b``,
``<`` ``\l`` and ``>`` ``\g``, so no text can hold a mark of the template, and reading back is exact.

Turns sort by turn (null first), role, text; repeated rows count as turns of their own. Null roles and texts are
empty; rows with a null conv_id form one conversation. A conversation has to fit into one row, as its last example
holds all of it. An empty table gives no examples. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"
TRAINED_ROLE = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example_no (from 0), text, loss_start, loss_end: the mask in code points of text, null without a target."""
    empty = F.lit("")
    rows = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written_turns = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.element_at("turns", i)["role"] == TRAINED_ROLE) | (i == F.size("turns")),
    )
    examples = turns.withColumn("parts", written_turns).select("conv_id", "turns", "parts", F.posexplode(ends).alias("example_no", "end"))
    text, last = F.array_join(F.slice("parts", 1, F.col("end")), ""), F.element_at("turns", F.col("end"))
    end = F.length("text") - len(CLOSE)
    start = end - F.length(escape(last["text"]))
    trained = last["role"] == TRAINED_ROLE
    return examples.withColumn("text", text).select(
        "conv_id",
        "example_no",
        "text",
        F.when(trained, start).cast("long").alias("loss_start"),
        F.when(trained, end).cast("long").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""
    parts = F.filter(F.split(text, CLOSE), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(x, MIDDLE, -1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its examples: number and SHA-256 of its turns and of what is trained on."""
    masked = unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    whole = examples.select("conv_id", "example_no", "text", F.coalesce(masked, F.lit("")).alias("masked")).groupBy("conv_id").agg(
        F.max_by("text", "example_no").alias("text"),
        F.sort_array(F.collect_list(F.struct("example_no", "masked"))).alias("masked"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("masked", lambda x: x["masked"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", read_turns(F.col("text")).alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"),
        F.lit(text).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(prefix_target_examples(rows.unionByName(probe)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         sum(15 + length(role) + length(text)
             + len(regexp_extract_all(role || text, '[\\<>]'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(any_value(n_turns) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = n_turns THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
