"""JSON replies of a language model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def unfenced(reply: Column) -> Column:
    """The reply without a code fence around it."""
    text = strip(reply)
    body = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(?U)(?:^|\n)\s*```\s*$", "")
    return F.when(F.startswith(text, F.lit("```")), body).otherwise(text)


def json_text(reply: Column) -> Column:
    """The reply's JSON: all of it, or from its first { to its last }; null if neither can be parsed."""
    whole = unfenced(reply)
    first = F.instr(whole, "{")
    last = F.length(whole) - F.instr(F.reverse(whole), "}") + 1
    inner = F.when((first > 0) & F.contains(whole, F.lit("}")) & (last > first), F.substring(whole, first, last - first + 1))
    good = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(good(whole), whole).when(good(inner), inner)


def reply_failed(reply: Column) -> Column:
    """True if the reply holds no JSON object, or one with an error."""
    text = json_text(reply)
    is_object = F.coalesce(F.startswith(strip(text), F.lit("{")), F.lit(False))
    return ~is_object | F.get_json_object(text, "$.error").isNotNull()
