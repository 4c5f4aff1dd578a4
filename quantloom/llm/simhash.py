"""Operator 4: SimHash near-dedup with vantage-point trees.

Fingerprints of all texts are made once and staged. Equal fingerprints are one point. A tree of vantage points, fitted
on a bounded sample, routes the points to shards; a point near a boundary goes to both sides. Each shard joins its pairs
by the same rule and returns a spanning link for each point, not all pairs. Links of all shards give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, components, sample_rows, stage, texts
from quantloom.llm.vantage import fit, link_close, route

WORDS, SEED, REACH = 3, 42, 2
#: Points that a shard should hold, and fingerprints in the sample that fits the tree.
SHARD_POINTS, SAMPLE = 20_000, 32_768
#: A shard with more points than this (a dense ball no vantage parts) is joined by shared midpoints instead.
MOST_POINTS = 400_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the shingles of a text: a bit is 1 if set in over half of their XXH64 hashes. No words: 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII separators alone
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = sizes.cumsum() - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)])
    n, total = len(hashes) // 8, np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8)[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp the 64 bits of the fingerprint as a signed long."""

    def make(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "fp": [_signed(fingerprint(t)) for t in part.column("text").to_pylist()]}

    return arrow_map(texts(df, id_col, text_col), make, "doc_id long, fp long")


def fingerprint_links(points: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (column ``fp``), enough that components are those of all close pairs."""
    spark = points.sparkSession
    n = points.count()
    sample = sample_rows(points, "fp", SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree, shards = fit(sample, -(-n // SHARD_POINTS) if n else 1, REACH)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if len(fp):
                at, shard = route(tree, fp, REACH)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fp[at].view(np.int64))], ["shard", "fp"])

    def join(table: pa.Table) -> pa.Table:
        fp = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        root = link_close(fp, REACH)
        own = root != np.arange(len(fp))
        return pa.table({"a": fp[own].view(np.int64), "b": fp[root[own]].view(np.int64)})

    sent = points.mapInArrow(send, "shard int, fp long")
    if shards == 1:
        return sent.groupBy("shard").applyInArrow(join, "a long, b long")
    sent = stage(sent, "shards")
    sizes = {r[0]: r[1] for r in sent.groupBy("shard").count().collect()}  # one row for each shard
    large = [s for s, k in sizes.items() if k > MOST_POINTS]
    links = sent.where(~F.col("shard").isin(large)) if large else sent
    links = links.groupBy("shard").applyInArrow(join, "a long, b long")
    return links.union(_midpoint_links(sent.where(F.col("shard").isin(large)))) if large else links


def _midpoint_links(sent: DataFrame) -> DataFrame:
    """Links of a dense ball without gathering it: points within 2 bits share a value at one bit or less from each."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    keys = sent.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("b"))
    return keys.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints of at most 2 differing bits link. Texts without words (null, empty, white space) have fingerprint zero
    and link like any other. Repeated rows give equal rows; rows with a null id give the component of the others, null
    if there are no others. An empty table gives no rows.
    """
    prints = stage(fingerprints(df, id_col, text_col), "fingerprints")
    least = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    links = fingerprint_links(least.select("fp"))
    groups = components(links).withColumnsRenamed({"node": "fp", "component": "group"})
    least = least.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    first = least.groupBy("group").agg(F.min("least").alias("component_id"))
    known = least.join(first, "group").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(known, "fp").select("doc_id", hexed, "component_id")
