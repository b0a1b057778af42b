"""Embedding of texts in batches behind a small protocol."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]


class EmbedderError(RuntimeError):
    pass


def load_embedder(factory: str) -> Embedder:
    """Call ``module:function``."""
    module, _, name = factory.partition(":")
    return getattr(importlib.import_module(module), name)()


def check_reply(texts: list[str], vectors: list[list[float]], dim: int) -> list[list[float]]:
    """One vector for each text, all of the dimension and finite; anything else ends the lane."""
    if len(vectors) != len(texts) or any(len(v) != dim or not all(map(math.isfinite, v)) for v in vectors):
        raise EmbedderError("the embedder's reply does not fit its request")
    return vectors


def embed_table(docs: DataFrame, make: Callable[[], Embedder], dim: int, text: str = "text", batch: int = 64) -> DataFrame:
    """doc_id and embedding; ``make`` is called once a task, on the executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                texts = ["" if t is None else t for t in part[text]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "embedding": check_reply(texts, embed(texts), dim)})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, embedding array<float>")
