"""Quality by nearest-neighbour voting over latent-semantic vectors.

Style n-grams of a bounded sample of labelled texts are weighted by TF-IDF and reduced by a singular value decomposition.
The sample's vectors are broadcast (their number is a parameter); every document's cosine with all of them is computed in
blocks, and the labels of the nearest vote with weights that grow with similarity.

Edge cases: an empty or null text has a zero vector, no neighbour votes, and it gets the prior (one half per class, as the
sample is balanced); without usable labels every score is 0.5; labels other than 0 and 1 are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .features import bounded_sample, collected, inverse_frequency, style, weighted

#: Labelled rows that are learned from, of each label.
PER_LABEL = 1000
DIMENSIONS, NEIGHBOURS, POWER, THRESHOLD = 48, 21, 16.0, 0.3
BLOCK = 512


def fit(labels: list[str], counts: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    idf = inverse_frequency(counts)
    x = weighted(counts, idf)
    values, vectors = np.linalg.eigh(x @ x.T)
    top = np.argsort(values)[::-1][: min(dimensions, len(x))]
    top = top[values[top] > 1e-6]
    basis = (x.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
    return {"idf": idf, "basis": basis, "known": unit(x @ basis), "good": np.array([float(v) for v in labels], np.float32)}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(model: dict, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    cosine = unit(weighted(counts, model["idf"]) @ model["basis"]) @ model["known"].T
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** POWER
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * model["good"][near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5).clip(0, 1)


def quality_classifier(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    rows = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").alias("label")).distinct()
    found = collected(bounded_sample(rows, docs, per_label), style)
    model = docs.sparkSession.sparkContext.broadcast(fit(*found) if len(set(found[0])) > 1 else None)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                s = votes(model.value, np.stack([style(t) for t in part["text"]])) if model.value else np.full(len(part), 0.5)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    df = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return df.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
