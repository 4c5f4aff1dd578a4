"""SimHash near-duplicates, wide enough for a Jaccard similarity of word-shingle sets, with an exact check.

Texts of equal sets are one point, with a SimHash fingerprint of 256 bits. Every pair is chosen by the Hamming distance of
its fingerprints; links are only those whose sets, made anew from the texts, reach the similarity.

1. Fingerprints of at most two different bits among the first 64 are found by operator 4's vantage points.
2. Sets of similarity 0.8 differ in about 39 of 256 bits, unlike ones in 128 +- 8: a reach of REACH bits parts them, but
   no tree of vantage points parts anything at such a reach. So bands of MinHash values deal the points out, and within
   a band fingerprints are compared. In each band all points are first held against one of them, the one that meets
   most points over all its bands (the text that copies were made from, where there is one): as many pairs as points.
3. Bands that still hold several components send their points' sets to one task (a band too large for a task: to one
   task for each two of its parts). There the fingerprints of every pair of different components are compared, then the
   sets of those within reach, and each link joins two components at once, so that what is left to compare shrinks; a
   link for each joining is sent on, no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, components, key_of, slices, stage, texts
from quantloom.llm.simhash import fingerprint_links

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: 64-bit words of a fingerprint, and bits that fingerprints of similar sets may differ in: at 0.8 the mean is 39, 48 in the
#: worst case (sets of four and five runs), with a deviation of 6, so a pair is missed with probability 1e-12 or less.
PRINT_WORDS, REACH = 4, 96
#: A pair of similarity 0.8 shares none of 30 bands of 4 values with probability 1.3e-7.
BANDS, VALUES = 30, 4
#: Bytes of shingle sets that one part of a band should hold.
PART_BYTES = 16 << 20
#: Shingle sets that a task keeps between pairs.
KEPT_SETS = 128
_KEYS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * VALUES, 1), dtype=np.uint64) | np.array([0, 1], np.uint64)[:, None, None]

_MIXES = np.append(np.uint64(1), np.random.default_rng(SEED + 1).integers(0, 1 << 63, PRINT_WORDS - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_MIXED = np.array([0] + [1] * (PRINT_WORDS - 1), np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; a shorter text is one run; without words there are none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(r, SEED) for r in runs]), ">u8").astype(np.uint64))


def bands_of(found: np.ndarray) -> list[int]:
    """A key for each band of MinHash values; none for a text without words."""
    if not len(found):
        return []
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, ((found[at : at + 512] ^ _KEYS[0]) * _KEYS[1]).min(axis=1), out=least)
    values = (least >> np.uint64(32)).astype(np.uint32)
    return [xxhash.xxh64_intdigest(v.tobytes(), i) - (1 << 63) for i, v in enumerate(values.reshape(BANDS, VALUES))]


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, as PRINT_WORDS signed longs: a bit is 1 if set in over half of the hashes, the
    first word's, or of their mixes, the other words'. None: zero."""
    total = np.zeros(64 * PRINT_WORDS, np.int64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096, None] * _MIXES
        part[:, 1:] = (part[:, 1:] ^ (part[:, 1:] >> np.uint64(32))) * _MIXES[1:]
        total += np.unpackbits((part ^ (part >> np.uint64(29)) * _MIXED).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(found)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(df, id_col, text_col)
    rows = rows.withColumn("key", key_of(F.col("doc_id"), F.col("text")))

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("fp", "size", "bands", "print")}
        for text in part.column("text").to_pylist():
            found = shingles(text)
            out["fp"].append(int.from_bytes(hashlib.sha256(found.tobytes()).digest()[:8], "big", signed=True))
            out["size"].append(len(found))
            out["bands"].append(bands_of(found))
            out["print"].append(fingerprint(found))
        return out | {c: part.column(c) for c in ("key", "doc_id", "text")}

    return arrow_map(rows, make, "key binary, doc_id long, text string, fp long, size long, bands array<long>, print array<long>", rows=64)


def _close(sets: DataFrame) -> DataFrame:
    """(a, b): points whose fingerprints are joined by steps of at most two of the first 64 bits, by vantage points; a link
    for each point that has another, to be checked."""
    prints = sets.where("size > 0").select("fp", F.col("print")[0].alias("first"))
    least = stage(prints.groupBy("first").agg(F.min("fp").alias("a")), "prints")
    same = prints.join(least, "first").where("fp <> a").select("a", F.col("fp").alias("b"))
    links = fingerprint_links(least.select(F.col("first").alias("fp"))).withColumnsRenamed({"a": "x", "b": "y"})
    ends = links.join(least.select(F.col("first").alias("x"), "a"), "x").join(least.select(F.col("first").alias("y"), F.col("a").alias("b")), "y")
    return stage(same.union(ends.select("a", "b")), "close-prints")


def _within_reach(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose fingerprints differ in at most REACH bits."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("print").alias("p")), "a").join(sets.select(F.col("fp").alias("b"), F.col("print").alias("q")), "b")
    bits = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(PRINT_WORDS)), F.lit(0))
    return both.where(bits <= REACH).select("a", "b")


def _verified(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}

        def sets(text: str) -> np.ndarray:
            if (got := kept.get(text)) is None:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                got = kept[text] = shingles(text)
            return got

        for part in slices(batches, 64):
            good = [jaccard(sets(x), shingles(y)) >= SIMILARITY for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = pairs.join(text.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b")
    return stage(side.join(text.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-pairs")


def _sets(text: DataFrame) -> DataFrame:
    """(fp, found, print): the shingle hashes and the fingerprint as bytes."""

    def make(part: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in part.column("text").to_pylist()]
        return {"fp": part.column("fp"), "found": [x.tobytes() for x in found], "print": [fingerprint(x).tobytes() for x in found]}

    return arrow_map(text.select("fp", "text"), make, "fp long, found binary, print binary", rows=64)


def joinings(sets: list[np.ndarray], prints: np.ndarray, component: np.ndarray, part: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Pairs within ``reach`` and of SIMILARITY or more that join components of one band: enough for all that its pairs join.

    With two different parts only pairs across them are compared.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = size.cumsum() - size
    component, out = component.copy(), []
    across = part.min() != part.max()
    mark = np.zeros(len(ids) + 1, bool)
    rows = [ids[a : a + n] for a, n in zip(starts.tolist(), size.tolist(), strict=True)]
    for i in np.argsort(-size, kind="stable").tolist():  # each pair is met at its larger side
        ok = (component != component[i]) & (size <= size[i]) & (size >= SIMILARITY * size[i])
        if across:
            ok &= part != part[i]
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(prints[at] ^ prints[i]).sum(axis=1, dtype=np.int64) <= reach]
        if not len(at):
            continue
        mark[rows[i]] = True
        chosen = np.concatenate([rows[j] for j in at.tolist()]) if len(at) < len(sets) // 2 else ids
        first = (size[at].cumsum() - size[at]) if chosen is not ids else starts
        both = np.add.reduceat(mark[chosen], first, dtype=np.int64)
        both = both if chosen is not ids else both[at]
        mark[rows[i]] = False
        for j in at[both >= SIMILARITY * (size[at] + size[i] - both)].tolist():
            if component[j] != component[i]:
                out.append((i, j))
                component[component == component[j]] = component[i]
    return out


def _joined(table: pa.Table, reach: int) -> pa.Table:
    fp, component, part = (table.column(c).to_numpy() for c in ("fp", "component", "part"))
    found = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
    prints = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(-1, PRINT_WORDS)
    pairs = joinings(found, prints, component, part, reach)
    return pa.table({"a": pa.array([int(fp[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(fp[j]) for _, j in pairs], pa.int64())})


def _grouped(links: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with component, the least fp that a chain of links reaches."""
    found = components(links).withColumnRenamed("node", "fp")
    return points.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, component_id (the smallest id that a chain of pairs of SIMILARITY or more reaches;
    ids may be null), and key (``common.key_of``) and group (a number of the component, whatever the ids).

    Texts without words are alike. Rows of one id and different texts are different points. Other columns are left out,
    whatever their names. An empty table gives no rows.
    """
    points = stage(_points(df, id_col, text_col), "points")
    sets = stage(points.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "bands", "print")]), "sets")
    close = _close(sets)
    bands = sets.select("fp", "size", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    bands = stage(bands.join(shared, "band"), "bands")
    ends = bands.select("fp").union(close.select("a")).union(close.select("b")).distinct()
    # any text of the set will do
    text = stage(points.select("fp", "text").join(ends, "fp", "left_semi").dropDuplicates(["fp"]), "shared-texts")
    meets = bands.groupBy("fp").agg(F.sum("n").alias("meets"))
    central = bands.join(meets, "fp").groupBy("band").agg(F.max(F.struct("meets", "fp"))["fp"].alias("a"))
    tested = bands.join(central, "band").where("fp <> a").select("a", F.col("fp").alias("b")).union(close).distinct()
    links = _verified(_within_reach(tested, sets), text)
    bands = stage(_grouped(links, bands.select("fp", "size", "band")), "band-groups")
    mixed = bands.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum(F.col("size") * 8).alias("bytes")).where("x <> y")
    mixed = stage(mixed.select("band", F.ceil(F.col("bytes") / PART_BYTES).cast("int").alias("parts")), "mixed-bands")
    open_ = stage(bands.join(mixed, "band").select("fp", "band", "component", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")), "open-points")
    found = stage(_sets(text.join(open_.select("fp").distinct(), "fp", "left_semi")), "open-sets")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("low"), F.greatest(p, "part").alias("high"))))
    sent = open_.select("fp", "band", "component", "part", pair.alias("pair")).join(found, "fp")
    reach = REACH
    more = stage(sent.groupBy("band", "pair").applyInArrow(lambda table: _joined(table, reach), "a long, b long"), "joinings")
    known = stage(_grouped(links.union(more), points.select("key", "doc_id", "fp")), "known")
    first = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return known.join(first, "component").select("doc_id", "component_id", "key", F.col("component").alias("group"))
