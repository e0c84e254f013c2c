"""Hooks for models: batches of pairs to scores, batches of texts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType


def shared_terms(questions: list[str], texts: list[str]) -> list[float]:
    """Default scorer: the share of a question's words that stand in the text, less a little for its length."""
    out = []
    for q, x in zip(questions, texts, strict=True):
        asked, held = set(q.lower().split()), x.lower().split()
        out.append(len(asked & set(held)) / max(1, len(asked)) - len(held) * 1e-6)
    return out


def rerank(pairs: DataFrame, question: str, text: str, score: Callable[[list[str], list[str]], list[float]] = shared_terms, batch: int = 32) -> DataFrame:
    """Adds ``rerank``; any model that maps batches of pairs to scores can stand in for the default."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            values: list[float] = []
            for k in range(0, len(pdf), batch):
                values += score(pdf[question].iloc[k : k + batch].tolist(), pdf[text].iloc[k : k + batch].tolist())
            yield pdf.assign(rerank=values)

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("rerank", DoubleType())]))


def embed(docs: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """Adds ``embedding`` in batches of ``batch`` texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[list[float]] = []
            for k in range(0, len(pdf), batch):
                vectors += model(pdf[text].iloc[k : k + batch].tolist())
            yield pdf.assign(embedding=vectors)

    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField("embedding", ArrayType(FloatType()))]))
