"""Operator 2: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed words plus a few shape features (how much of it is symbols, digits, capitals, repeats).
A truncated SVD of at most SAMPLE labelled training texts gives the latent space. The labelled vectors are broadcast;
every document's exact cosine products with all of them are computed in blocks, and its nearest neighbours vote with
their similarity as weight.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.llm.common import arrow_map, sample_rows, stage, texts

BUCKETS, LEVELS, LATENT = 4096, 8, 48
#: Labelled documents that the classifier is fitted on, at most (those of the smallest hash): the bound of the broadcast.
SAMPLE = 3072
NEIGHBOURS, SHARPNESS, SHAPE_WEIGHT = 25, 6.0, 1.5
BLOCK = 64
ACCEPT = 0.7
_SHAPES = 9
DIMENSIONS = BUCKETS + _SHAPES * LEVELS
_WORDS: dict[str, int] = {}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _bucket(word: str) -> int:
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    got = _WORDS[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
    return got


def _shapes(text: str, words: list[str], counts: np.ndarray) -> list[float]:
    """Nine shares between 0 and 1 that describe the whole text's form."""
    n, m = max(1, len(text)), max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    symbols = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum() - kinds[[44, 46]].sum()
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        float(symbols) / n * 4,
        float(kinds[48:58].sum()) / n * 4,
        float(kinds[65:91].sum()) / n * 4,
        float(kinds[[44, 46]].sum()) / m,
        repeats / m * 2,
        float(counts.max(initial=0)) / m * 2,
        1 - len(set(lines)) / len(lines),
        n / m / 16,
        float(np.log1p(m)) / 12,
    ]


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of a text: damped word counts, then one level for each shape; idf is applied later."""
    words = text.split()
    get = _WORDS.get
    counts = np.bincount(np.array([b if (b := get(w)) is not None else _bucket(w) for w in words], np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    levels = np.minimum(np.array(_shapes(text, words, counts)) * LEVELS, LEVELS - 1).astype(np.int64)
    return np.concatenate([at, BUCKETS + np.arange(_SHAPES) * LEVELS + levels]), np.concatenate([np.log1p(counts[at]), np.ones(_SHAPES)]).astype(np.float32)


def _latent(at: np.ndarray, weight: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    w = weight * idf[at]
    word = at < BUCKETS
    size = float(np.sqrt((w[word] ** 2).sum()))
    w[word] /= size or 1.0
    w[~word] *= SHAPE_WEIGHT / np.sqrt(_SHAPES)
    return w @ axes[at]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> dict:
    """Latent axes, idf and labelled vectors from sparse rows and their 0/1 labels. No rows: a model that votes 0.5."""
    n = len(rows)
    if not n:
        return {"idf": np.ones(DIMENSIONS, np.float32), "axes": np.zeros((DIMENSIONS, 1), np.float32), "known": np.zeros((0, 1), np.float32), "labels": labels}
    df = np.bincount(np.concatenate([a for a, _ in rows]), minlength=DIMENSIONS)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    idf[BUCKETS:] = 1
    x = np.zeros((n, DIMENSIONS), np.float32)
    eye = np.ones(DIMENSIONS, np.float32)
    for i, (at, w) in enumerate(rows):
        v = w * idf[at] * eye[at]
        word = at < BUCKETS
        v[word] /= np.sqrt((v[word] ** 2).sum()) or 1.0
        v[~word] *= SHAPE_WEIGHT / np.sqrt(_SHAPES)
        x[i, at] = v
    k = min(LATENT, n)
    q = np.random.default_rng(0).standard_normal((DIMENSIONS, k + 16)).astype(np.float32)
    for _ in range(3):  # randomised range finder with power iterations
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = (np.linalg.svd(x @ q, full_matrices=False)[2][:k] @ q.T).T.astype(np.float32)
    return {"idf": idf, "axes": np.ascontiguousarray(axes), "known": _unit(x @ axes).astype(np.float32), "labels": labels.astype(np.float32)}


def vote(model: dict, latent: np.ndarray) -> np.ndarray:
    """Similarity-weighted mean label of the nearest labelled vectors, for a block of latent vectors."""
    known, labels = model["known"], model["labels"]
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(known):
        return np.full(len(latent), prior)
    # in blocks of one shape and in double precision: a row's products then don't depend on the rows beside it
    unit, turned = _unit(latent.astype(np.float64)), known.T.astype(np.float64)
    block, cosine = np.zeros((BLOCK, latent.shape[1])), np.empty((len(latent), len(known)))
    for at in range(0, len(latent), BLOCK):
        part = unit[at : at + BLOCK]
        block[: len(part)] = part
        cosine[at : at + BLOCK] = (block @ turned)[: len(part)]
    cosine = np.round(cosine, 9)
    k = min(NEIGHBOURS, len(known))
    at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, at, 1), 0).astype(np.float64) ** SHARPNESS + 1e-9
    return np.clip((weight * labels[at]).sum(1) / weight.sum(1), 0, 1)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on the ``sample`` labelled, not held-out documents of the smallest hash. A document of several labels counts
    with their rounded mean; null labels don't count."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    ids = documents.select(documents[id_col].cast("long").alias("doc_id")).distinct()
    chosen = stage(sample_rows(known.join(ids, "doc_id", "left_semi"), "doc_id", sample), "chosen")
    rows = texts(documents, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most

    def make(part: pa.RecordBatch) -> dict:
        made = [sparse(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "y": part.column("y"), "at": [a for a, _ in made], "w": [w for _, w in made]}

    got = arrow_map(rows, make, "doc_id long, y int, at array<int>, w array<float>").orderBy("doc_id").limit(2 * sample).toPandas()
    return fit([(np.asarray(a, np.int64), np.asarray(w, np.float32)) for a, w in zip(got["at"], got["w"], strict=True)], got["y"].to_numpy(np.int64))


def score(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with ``whole`` also the row itself, in a struct ``row``.

    The score depends on the text alone: equal texts score equally; null texts count as empty ones, which have a score
    like any other (their shapes vote). Rows of a null id are scored too and are not held out. Other columns, whatever
    their names, are left out or stay in ``row``. Repeated rows give equal rows; an empty table none.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SAMPLE * LATENT + DIMENSIONS * LATENT numbers
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col], F.lit("")).alias("text"), *([F.struct(*[documents[c] for c in documents.columns]).alias("row")] if whole else []))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    keep = [c for c in rows.columns if c != "text"]

    def make(part: pa.RecordBatch) -> dict:
        m = shared.value
        made = [sparse(t) for t in part.column("text").to_pylist()]
        latent = np.stack([_latent(a, w, m["idf"], m["axes"]) for a, w in made]) if made else np.zeros((0, 1), np.float32)
        return {c: part.column(c) for c in keep} | {"score": vote(m, latent)}

    schema = StructType([rows.schema[c] for c in keep]).add("score", "double")
    return arrow_map(rows, make, schema).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
