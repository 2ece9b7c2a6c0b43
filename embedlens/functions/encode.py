"""Encoders: a user's function over batches, and a model-free hashing encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.functions.columns import hash60


def encode_with(df: DataFrame, id_col: str, item_col: str, make: Callable[[], Callable[[list], np.ndarray]], batch: int = 64) -> DataFrame:
    """(id, embedding) of every row. ``make()`` runs once in a task and returns ``encode(items) -> (n, d)``; rows are L2-normalised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                x = np.asarray(encode(part[item_col].tolist()), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": list(x)})

    return df.select(id_col, item_col).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<double>")


def hash_encode(df: DataFrame, id_col: str, text: str, dim: int = 64, n: int = 3) -> DataFrame:
    """(id, dim, value): signed hashed counts of character n-grams of the lower-cased text, L2-normalised; non-zero cells only."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    grams = df.where(F.length(t) >= n).select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n)))).alias("gram"))
    counted = grams.groupBy(id_col, "gram").agg(F.count("*").alias("c"))
    h = F.col("h")
    cells = counted.withColumn("h", hash60("enc", F.col("gram"))).select(id_col, F.pmod(h, F.lit(dim)).alias("dim"), (F.when(F.pmod(F.expr(f"h div {dim}"), F.lit(2)) == 0, 1).otherwise(-1) * F.col("c")).alias("s"))
    cells = cells.groupBy(id_col, "dim").agg(F.sum("s").alias("s")).where("s <> 0")
    size = cells.groupBy(id_col).agg(F.sqrt(F.sum(F.col("s").cast("double") * F.col("s"))).alias("size"))
    return cells.join(size, id_col).select(id_col, "dim", (F.col("s") / F.col("size")).alias("value"))


def _letters() -> Callable[[list], np.ndarray]:
    """Counts of the letters a to z, in any case."""

    def encode(items: list) -> np.ndarray:
        out = np.zeros((len(items), 26))
        for i, text in enumerate(items):
            raw = np.frombuffer((text or "").lower().encode(), np.uint8)
            out[i] = np.bincount(raw[(raw >= 97) & (raw <= 122)] - 97, minlength=26)
        return out

    return encode


def _word_lengths() -> Callable[[list], np.ndarray]:
    """Counts of words of 1 to 15 characters, and of longer ones."""

    def encode(items: list) -> np.ndarray:
        return np.array([np.bincount([min(len(w), 16) - 1 for w in (text or "").split()], minlength=16) for text in items], float).reshape(-1, 16)

    return encode


#: Encoders that ``encode_with`` takes by name; a user adds their own: a function that loads a model once a task and returns ``encode``.
ENCODERS: dict[str, Callable[[], Callable[[list], np.ndarray]]] = {"letters": _letters, "word_lengths": _word_lengths}


def encode_by_name(df: DataFrame, id_col: str, item_col: str, name: str, batch: int = 64) -> DataFrame:
    return encode_with(df, id_col, item_col, named(ENCODERS, name), batch)


def named(registry: dict, name: str):
    """A registered choice; an unknown name raises with the known ones."""
    if name not in registry:
        raise KeyError(f"unknown name {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]
