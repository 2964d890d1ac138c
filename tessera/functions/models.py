"""Interfaces of external models. Models are inputs: nothing here calls a service or makes up a score."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Adds a column `vector` to rows."""

    def embed(self, rows: DataFrame) -> DataFrame: ...


class Judge(Protocol):
    """Adds a column `score` to rows of a question, an answer and contexts."""

    def score(self, rows: DataFrame) -> DataFrame: ...


class TableEmbedder:
    """Vectors that were computed before, by key."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.vectors, self.key = vectors.select(key, F.col(vector).alias("vector")), key

    def embed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.vectors, self.key)


#: A trace's score by the state of its law context.
STATUS_SCORE = {"ok": 1.0, "supplemented": 0.7, "case_only": 0.5, "missing": 0.0}
