"""Reading structured answers out of model text."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import strip

_FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def fenced_json(c: Column) -> Column:
    """The first fenced block of JSON, stripped; null without one."""
    return strip(_found(c, r"(?is)```json\s*(.*?)```"))


def fenced_code(c: Column) -> Column:
    """A fenced block, else what stands in single backticks, else the text; stripped."""
    return strip(F.coalesce(_found(c, r"(?is)```(?:[a-z]*\n)?(.*?)```"), _found(c, r"`([^`]+)`"), c))


def final_answer(c: Column) -> Column:
    """What follows the first 'Final Answer:', else the last 'Thought:' part, else the text."""
    answer = _found(c, r"(?is)final answer:(.*)")
    thoughts = F.split(c, r"(?i)thought:")
    return strip(F.coalesce(answer, F.when(F.size(thoughts) > 1, F.element_at(thoughts, -1)), c))


def is_final(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("final answer:"))


def balanced(text: str | None) -> str | None:
    """The fenced JSON block, or the text from the earliest bracket to its match (brackets in strings count too)."""
    import re

    if text is None:
        return None
    if m := re.search(r"(?is)```json\s*(.*?)```", text):
        return m[1].strip()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    at = min(starts)
    opening, closing, depth = text[at], {"{": "}", "[": "]"}[text[at]], 0
    for i in range(at, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if not depth:
            return text[at : i + 1]
    return None


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(balanced)


def python_literal(text: str | None) -> str | None:
    """A Python literal as JSON text; null where it is none."""
    try:
        return None if text is None else json.dumps(ast.literal_eval(text), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def literal_to_json(texts: pd.Series) -> pd.Series:
    return texts.map(python_literal)
