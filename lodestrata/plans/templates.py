"""Prompts of the question loop, by kind."""

from __future__ import annotations

from string import Template

TEMPLATES = {
    "columns": Template("Table: $table\nQuestion: $question\nName the columns that the question is about, as a JSON list of short names in a ```json block."),
    "cells": Template("Table: $table\nQuestion: $question\nName the words or values of cells that the question is about, as a JSON list in a ```json block. Leave numbers out."),
    "solve": Template(
        "Table: $table\nColumns: $columns\nCells: $cells\nQuestion: $question\n$history\n"
        "Either give the next step as a ```json block with the fields filters ([column, operator, value]), group_by, aggs ([function, column, name]), order_by ([name, descending]) and limit, "
        "or end with a line 'Final Answer: ' and the answer."
    ),
    "graph": Template("Graph:\n$schema\nQuestion: $question\n$failure\nGive one query that begins with MATCH, has one relation, and returns properties."),
}


def prompt(kind: str, **told: object) -> str:
    """The prompt of a kind; an unknown kind, or a field that is missing, is a ValueError."""
    if kind not in TEMPLATES:
        raise ValueError(f"unknown prompt: {kind}")
    try:
        return TEMPLATES[kind].substitute(told)
    except KeyError as missing:
        raise ValueError(f"prompt {kind} needs {missing}") from None
