"""A console: python -m lodestrata FOLDER reads questions line by line; exit or the end of input ends it."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from .engine import Engine


def chat(engine: Engine, lines: Iterable[str], out: TextIO) -> int:
    """Answers each line that isn't blank; the number of answers."""
    n = 0
    for line in lines:
        question = line.strip()
        if question.lower() == "exit":
            break
        if question:
            print(engine.ask(question), file=out, flush=True)
            n += 1
    return n


def main() -> None:
    from pyspark.sql import SparkSession

    if len(sys.argv) != 2:
        sys.exit(__doc__)
    chat(Engine.load(SparkSession.builder.appName("lodestrata").getOrCreate(), sys.argv[1]), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
