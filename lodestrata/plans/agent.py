"""The question loop over a table: what is named is looked up, then a model takes bounded steps of typed queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from ..functions.parse import balanced
from ..operators import retrieval
from .answer import NO_CONTEXT, OBSERVATION, truncated
from .ir import AGGREGATES, OPERATORS, TableQuery
from .models import ERROR, Model, Tracked, context_limit, tokens
from .templates import prompt

# Rounds of the loop, tokens of an answer, share of the context at which it stops, hits for a name, rows of an observation.
ROUNDS, ANSWER_TOKENS, CONTEXT_SHARE, HITS, ROWS = 7, 512, 0.8, 5, 50


def table_query(told: object) -> TableQuery:
    """A typed query out of a model's JSON; what isn't one is a ValueError that says why."""
    if not isinstance(told, dict) or not told.keys() <= {"filters", "group_by", "aggs", "order_by", "limit"}:
        raise ValueError("a step has the fields filters, group_by, aggs, order_by and limit")
    filters, aggs = [tuple(x) for x in told.get("filters") or ()], [tuple(x) for x in told.get("aggs") or ()]
    for x, known, n in ((filters, OPERATORS, 1), (aggs, AGGREGATES, 0)):
        if any(len(y) != 3 or y[n] not in known for y in x):
            raise ValueError(f"each of {x} needs three parts, one of them among {sorted(known)}")
    limit = told.get("limit")
    if limit is not None and (not isinstance(limit, int) or limit < 0):
        raise ValueError("limit is a number")
    return TableQuery(tuple(filters), tuple(told.get("group_by") or ()), tuple(aggs), tuple((c, bool(down)) for c, down in told.get("order_by") or ()), limit)


def observation(told: str, df: DataFrame) -> str:
    """What a step gives as text: rows, or what went wrong."""
    try:
        rows = table_query(json.loads(told)).run(df).take(ROWS)
    except Exception as error:  # a step may name what isn't there; the model is told
        return truncated(f"{ERROR}{str(error).split(chr(10))[0]}", OBSERVATION)
    return truncated(json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False), OBSERVATION) if rows else "no rows"


def names(text: str) -> list[str]:
    """The texts of a JSON list in a model's answer; none where there is no list."""
    try:
        found = json.loads(balanced(text) or "[]")
    except ValueError:
        return []
    return [x for x in found if isinstance(x, str) and x.strip()] if isinstance(found, list) else []


def numeric(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def looked_up(asked: list[str], index: DataFrame | None, k: int = HITS) -> list[str]:
    """Documents that are nearest to the names, each once, in the order of names and ranks."""
    if not asked or index is None:
        return []
    questions = index.sparkSession.createDataFrame(list(enumerate(asked)), "id long, text string")
    hits = sorted(retrieval.hits(index, questions, k).collect(), key=lambda r: (r["query_id"], r["rank"]))
    return list(dict.fromkeys(r["result_text"] for r in hits))


def solve(question: str, model: Model, df: DataFrame, table: str, columns: list[str], cells: list[str], rounds: int = ROUNDS) -> str:
    """The answer of at most `rounds` steps; a step before the last stops the loop where the next prompt would fill CONTEXT_SHARE of the context."""
    history, last = "", NO_CONTEXT
    for _ in range(rounds):
        asked = prompt("solve", table=table, columns=", ".join(columns), cells=", ".join(cells), question=question, history=history)
        if tokens(asked) > CONTEXT_SHARE * context_limit(model.name):
            break
        told = model.ask(asked, max_tokens=ANSWER_TOKENS)
        if told.startswith(ERROR):
            return last
        if m := re.search(r"(?is)final answer:(.*)", told):
            return m[1].strip()
        step = balanced(told)
        if step is None:
            return told.strip()
        last = observation(step, df)
        history += f"Step: {step}\nObservation: {last}\n"
    return last


def answer(question: str, model: Model, df: DataFrame, table: str, column_index: DataFrame | None = None, cell_index: DataFrame | None = None) -> tuple[str, Tracked]:
    """The answer to a question over a table, and the account of the model's calls."""
    own = model if isinstance(model, Tracked) else Tracked(model)
    columns = looked_up(names(own.ask(prompt("columns", table=table, question=question))), column_index) or df.columns
    cells = looked_up([x for x in names(own.ask(prompt("cells", table=table, question=question))) if not numeric(x)], cell_index)
    return solve(question, own, df, table, columns, cells), own
