"""The parts of an engine put together; each back end is optional."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import retrieval
from .plans import agent, graph_text
from .plans.answer import NO_CONTEXT, answer
from .plans.models import ERROR, Model, Tracked, context_limit
from .plans.planner import plan
from .sources.tables import read_table


@dataclass
class Engine:
    """Answers by rule where a question has a plan; else, with a model, by the question loop and the graph."""

    reviews: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    model: Model | None = None
    column_index: DataFrame | None = None
    cell_index: DataFrame | None = None
    table: str = "reviews"

    @classmethod
    def load(cls, spark: SparkSession, folder: str, model: Model | None = None) -> Engine:
        """From the Parquet tables of a folder: reviews, nodes and edges, those that are there; indexes of the reviews are built once."""
        found = {}
        for name in ("reviews", "nodes", "edges"):
            try:
                found[name] = read_table(spark, f"{folder}/{name}.parquet")
            except Exception:  # a back end that can't be read is one that isn't there
                found[name] = None
        built = retrieval.build_database(spark, f"{folder}/index", "reviews", found["reviews"]) if model is not None and found["reviews"] is not None else {}
        return cls(**found, model=model, column_index=built.get("schema"), cell_index=built.get("cell"))

    def ask(self, question: str) -> str:
        limit = {"limit": context_limit(self.model.name)} if self.model else {}
        if plan(question).entities or self.model is None:
            found = answer(question, self.reviews, self.nodes, self.edges, **limit)
            if found != NO_CONTEXT or self.model is None:
                return found
        own, blocks = Tracked(self.model), []
        if self.reviews is not None:
            blocks.append(agent.answer(question, own, self.reviews, self.table, self.column_index, self.cell_index)[0])
        if self.nodes is not None and self.edges is not None:
            blocks.append(graph_text.graph_answer(question, own, self.nodes, self.edges))
        known = [b for b in blocks if b != NO_CONTEXT and not b.startswith((ERROR, "Graph error"))]
        return "\n".join(known) or NO_CONTEXT
