"""Replies checked for their types before anything is cast: a number where a text belongs is an error, not that text.

A reply is a VARIANT, which keeps the types of its JSON. Texts have to be strings and lists arrays; a score is a number, or
what reads as one. What may be missing may also be null; extra members are of no matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_TYPES, CONDITIONS = ("boolean", "integer", "str", "float"), ("greater", "equal", "less")
CATEGORIES = ("auto", "manual", "critical")


def member(x: Column, name: str) -> Column:
    """A member of an object as a variant, null if it isn't there."""
    return F.try_variant_get(x, f"$.{name}", "variant")


def kind(x: Column) -> Column:
    """STRING, OBJECT, ARRAY and so on; VOID for what is missing or null."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(x), F.lit("VOID")), "^[A-Z]+", 0)


def absent(x: Column) -> Column:
    return kind(x) == "VOID"


def text(x: Column, legal: tuple[str, ...] = ()) -> Column:
    """Whether x is a text, and one of the legal ones if there are such."""
    fits = kind(x) == "STRING"
    return fits & F.coalesce(F.try_variant_get(x, "$", "string").isin(*legal), F.lit(False)) if legal else fits


def number(x: Column) -> Column:
    return ~kind(x).isin("OBJECT", "ARRAY", "VOID") & F.try_variant_get(x, "$", "double").isNotNull()


def every(x: Column, rule: Callable[[Column], Column]) -> Column:
    """Whether x is a list whose items all obey the rule."""
    return (kind(x) == "ARRAY") & F.coalesce(F.forall(F.try_variant_get(x, "$", "array<variant>"), lambda i: F.coalesce(rule(i), F.lit(False))), F.lit(False))


def _link(x: Column) -> Column:
    return (kind(x) == "OBJECT") & text(member(x, "deeplink")) & text(member(x, "description")) & _text_or_none(x, "message") & _text_or_none(x, "originalType")


def _text_or_none(x: Column, name: str, legal: tuple[str, ...] = ()) -> Column:
    return absent(member(x, name)) | text(member(x, name), legal)


def _check(x: Column) -> Column:
    kinds = _text_or_none(x, "resultType", RESULT_TYPES) & _text_or_none(x, "condition", CONDITIONS) & _text_or_none(x, "value")
    return (kind(x) == "OBJECT") & text(member(x, "deeplink")) & text(member(x, "key")) & kinds


def _group(x: Column) -> Column:
    link, check = member(x, "actionableDeeplink"), member(x, "validationDeeplink")
    return (kind(x) == "OBJECT") & every(member(x, "steps"), text) & (absent(link) | _link(link)) & (absent(check) | _check(check))


def _action(x: Column) -> Column:
    return (kind(x) == "OBJECT") & text(member(x, "actionName")) & text(member(x, "description")) & _text_or_none(x, "category", CATEGORIES) & every(member(x, "stepGroups"), _group)


def plan(x: Column) -> Column:
    return (kind(x) == "OBJECT") & text(member(x, "goal")) & text(member(x, "title")) & number(member(x, "score")) & every(member(x, "actions"), _action)


def well_typed(reply: Column) -> Column:
    """Whether a reply (a variant) is an object whose plans have all that a plan must have, of the right types. No plans is legal."""
    contexts = member(reply, "contexts")
    return (kind(reply) == "OBJECT") & (absent(contexts) | every(contexts, plan))
