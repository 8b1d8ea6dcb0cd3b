"""Answers out of small results, within the limits that their reader sets."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from .ir import QueryPlan
from .planner import plan

# Characters of a token, reserved and least tokens of a context, limits of texts.
CHARS_PER_TOKEN, RESERVED, LEAST, OBSERVATION, RECORDS = 3.5, 1024, 1000, 1000, 2500
CONTEXT_LIMIT = 128_000
NO_CONTEXT = "I could not find information that answers this question."


def truncated(text: str, limit: int, marker: str = "... (truncated)") -> str:
    return text if len(text) <= limit else text[:limit] + marker


def context_budget(overhead: int, limit: int = CONTEXT_LIMIT) -> int:
    return max(LEAST, limit - overhead - RESERVED)


def within_budget(text: str, tokens: int) -> str:
    return text if math.ceil(len(text) / CHARS_PER_TOKEN) <= tokens else text[: int(tokens * CHARS_PER_TOKEN)]


def records_report(rows: DataFrame | None, error: str | None = None) -> str:
    """Records as JSON text, or what went wrong, or that there are none."""
    if error or rows is None:
        return f"Graph error: {error or 'the graph is not available'}"
    found = [r.asDict(recursive=True) for r in rows.take(RECORDS)]  # more could not be shown
    return truncated(json.dumps(found, ensure_ascii=False, default=str), RECORDS) if found else "No specific results found."


def answer(question: str, reviews: DataFrame | None, nodes: DataFrame | None, edges: DataFrame | None, limit: int = CONTEXT_LIMIT) -> str:
    """The rule-based answer: each part of the plan that a source can serve, one block per part."""
    made: QueryPlan = plan(question)
    blocks = []
    for part in made.tables if reviews is not None else ():
        blocks += [", ".join(f"{k}: {v}" for k, v in row.asDict().items()) for row in part.run(reviews).take(50)]
    for part in made.graphs if nodes is not None and edges is not None else ():
        blocks.append(records_report(part.run(nodes, edges)))
    head = ", ".join(made.entities)
    text = "\n".join(x for x in (head, *blocks) if x)
    return within_budget(text, context_budget(math.ceil(len(question) / CHARS_PER_TOKEN), limit)) if blocks else NO_CONTEXT
