"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

A text's terms are its words and their shapes ("Aa.", "A!", "a#": letters by case, digits and other
characters, runs as one), hashed to ``TERMS`` slots, with a word that repeats its neighbour as a term
of its own. Log counts times inverse document frequency are reduced to ``RANK`` dimensions by a
truncated singular value decomposition, fitted with the labelled vectors on at most ``LABELLED`` rows
of each label. The labelled vectors (at most ``2 * LABELLED * RANK`` floats, whatever the corpus) go
to every task; each document's cosine with all of them is computed exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import Block, blocks, prefix_sums, span_hash, word_bounds

__all__ = ["LatentVectors", "fit_quality", "score_quality"]

TERMS = 1024
RANK = 48
LABELLED = 2_000
NEIGHBOURS = 25
_ROWS = 256

_SHAPE = np.full(256, 4, np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[128:] = 1
_SHAPE[[ord(c) for c in "#*$%&|<>@"]] = [5, 6, 7, 8, 9, 10, 11, 11, 12]
_SHAPE[ord("!")] = 13


def term_counts(block: Block, terms: int = TERMS) -> np.ndarray:
    """Rows of term frequencies (shares of the text's words) in hashed slots."""
    out = np.zeros((len(block), terms), np.float32)
    start, end, doc = word_bounds(block)
    if not len(start):
        return out
    word = span_hash(prefix_sums(block.data, fold=True), start, end)
    # Shapes: keep a character's class where it differs from the one before, or begins a word.
    kind = _SHAPE[block.data]
    fresh = np.append(True, kind[1:] != kind[:-1])
    fresh[start] = True
    place = np.cumsum(fresh)
    packed = kind[fresh]
    shape = span_hash(prefix_sums(packed), place[start] - 1, place[end - 1])
    repeated = np.zeros(len(word), bool)
    repeated[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    half = np.uint64(terms // 2)
    slots = [
        (word >> np.uint64(20)) % half,
        half + (shape >> np.uint64(20)) % (half - np.uint64(1)),
    ]
    flat = np.concatenate([doc * terms + s.astype(np.int64) for s in slots] + [doc[repeated] * terms + terms - 1])
    counts = np.bincount(flat, minlength=out.size).reshape(out.shape)
    words = np.maximum(np.bincount(doc, minlength=len(block)), 1)
    return (counts / words[:, None]).astype(np.float32)


@dataclass
class LatentVectors:
    """A fitted space with its labelled vectors; of bounded size."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        latent = (np.log1p(100 * counts) * self.idf) @ self.axes
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.maximum(length, 1e-9)

    def votes(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The share of similarity-weighted votes for label 1; the prior where there are no terms."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for at in range(0, len(counts), _ROWS):
            own = counts[at : at + _ROWS]
            cosines = self.project(own) @ self.vectors.T
            best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            # Similar texts are close to 1 in this space; the power tells near from nearer.
            weight = np.maximum(np.take_along_axis(cosines, best, 1), 0.0) ** 8 * self.weights[best]
            total = weight.sum(axis=1)
            share = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-12)
            known = (total > 1e-12) & own.any(axis=1)
            out[at : at + _ROWS][known] = share[known]
        return out


def fit_quality(
    documents: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", limit: int = LABELLED, rank: int = RANK
) -> LatentVectors:
    """Fit on the documents of at most ``limit`` rows of ``labels`` for each label 0 and 1.

    Those with the least hash of their id are taken, so the sample is at most ``2 * limit`` rows and is
    broadcast to find their texts. Of texts that share an id the least one is taken, and a label that
    repeats counts once, so no more rows than the sample's are fitted. Other labels, null ids and null
    texts are left out; labels without a document make the sample smaller. Without rows every score is 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    taken = [known.where(F.col("label") == k).orderBy(*order).limit(limit) for k in (0, 1)]
    sample = F.broadcast(taken[0].unionAll(taken[1]))
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(sample, F.col("own") == F.col("id")).groupBy("own", "label").agg(F.min("text").alias("text")).select("own", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = term_counts(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(block.rows.start, len(block)), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "terms"]
                )

    got = rows.mapInArrow(count, "label int, terms binary").toArrow()
    labels = got["label"].to_numpy().astype(np.int64)
    counts = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float32).reshape(len(labels), TERMS)
    order_of = np.lexsort((*(counts[:, k] for k in range(0, TERMS, 97)), labels))
    labels, counts = labels[order_of], counts[order_of]
    prior = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = np.log1p(100 * counts) * idf
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = vectors[:, ::-1][:, :rank].astype(np.float32)
    model = LatentVectors(idf, axes, np.zeros((0, rank), np.float32), labels, np.zeros(0), prior)
    if len(labels):
        model.vectors = model.project(counts)
        taken_of = np.bincount(labels, minlength=2)
        model.weights = np.array([totals.get(k, 0) / max(1, taken_of[k]) for k in (0, 1)])[labels]
    return model


def score_quality(documents: DataFrame, model: LatentVectors, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, score (0 to 1, higher: label 1 likelier), predicted (0 or 1).

    The whole text is read and nothing else. Null, empty and wordless texts get the share of label 1
    among the labelled rows. Repeated rows get equal scores, null ids stay.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                votes = np.clip(model.votes(term_counts(block)), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.rows.start, len(block)), pa.array(votes), pa.array((votes >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return docs.mapInArrow(score, "doc_id long, score double, predicted int")
