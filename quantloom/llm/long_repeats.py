"""Operator 10: removal of long repeated byte strings, by run-length indexes of the corpus's repetitive parts.

1. Every text is winnowed: of the LENGTH - GRAM + 1 strings of GRAM bytes within each string of LENGTH bytes, the one of
   the least hash is its anchor. Equal strings have equal anchors at equal places, wherever they stand.
2. An anchor that stands for its strings in one place alone has none that is repeated. For each other anchor, the
   strings it stands for make one stretch of bytes, its context. Equal contexts are kept once, counted.
3. Contexts go to shards by anchor. Each shard builds the run-compressed Burrows-Wheeler transform of its contexts, with
   sampled run ends, streams the matching statistics and marks matches of LENGTH bytes or more.
4. Marks come back to their documents, overlap there, and go.

Of an anchor with more bytes of context than a task should hold, the strings that stand alone are first left out, by
their hashes, pre-summed in each task; what is left of its contexts goes to the index like any other. Where even that is
more than a task should hold, the anchor is split: its contexts are winnowed again by longer strings, at last by whole
ones of LENGTH bytes, and go to shards by those. So every repeated string reaches an index, whatever an anchor brings.
Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, key_of, slices, stage, texts
from quantloom.llm.run_index import RunIndex

LENGTH, GRAM = 400, 64
#: Words of a repeated passage, at least, and bytes of a word's code.
PASSAGE_WORDS, CODE = 51, 4
_TOKEN = re.compile(rb"\S+")  # parted by the six ASCII white-space bytes
#: Bytes of context that a shard should hold, that one anchor may bring to it as it is, and that its repeated parts may.
#: An index takes about 40 bytes of memory for each.
SHARD_BYTES, ANCHOR_BYTES, PART_BYTES = 1 << 20, 8 << 20, 8 << 20
#: Texts are winnowed in blocks of so many strings.
BLOCK = 1 << 19
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    size = 1 << max(12, (n + 1).bit_length())
    if (got := _POWERS.get((base, size))) is None:
        b = int(_PRIMES[base])
        up, down = np.full(size, _PRIMES[base], np.uint64), np.full(size, np.uint64(pow(b, -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[base, size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return got


def rolling(data: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of each string of ``width`` bytes."""
    n = len(data)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    x = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def winnow(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor: it stands for the strings that begin at first to last."""
    raw = np.frombuffer(data, np.uint8)
    strings = len(raw) - length + 1
    if strings <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner, hashes = np.empty(strings, np.int64), []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, strings, BLOCK):
        part = raw[at : min(len(raw), at + BLOCK + length - 1)]
        h = rolling(part, gram)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        local = (least & low).astype(np.int64)
        owner[at : at + len(local)] = local + at
        places = np.unique(local)
        hashes.append((places + at, h[places]))
    place = np.concatenate([p for p, _ in hashes])
    value = np.concatenate([h for _, h in hashes])
    place, first_of = np.unique(place, return_index=True)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], strings) - 1
    # an anchor's strings follow one another: the leftmost least place never moves back
    return owner[first], value[first_of[np.searchsorted(place, owner[first])]], first, last


def contexts(data: bytes, repeated: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[tuple[int, bytes], list[int]]:
    """Where each context of the anchors of ``repeated`` hashes begins, by hash and context: text that repeats itself has
    the same anchor and context at many places, which go on as one."""
    _, value, first, last = winnow(data, length, gram)
    value = value.view(np.int64)
    good = np.isin(value, repeated)
    out: dict[tuple[int, bytes], list[int]] = {}
    for h, a, b in zip(value[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True):
        out.setdefault((h, data[a : b + length]), []).append(a)
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive numbers."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1]


def mark_shard(parts: list[bytes], counts: list[int], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first, last) of the strings of each context that occur more than once in the shard.

    Equal contexts stand in the index once, with their number: a suffix of a context that occurs again matches its twin
    to the context's end.
    """
    if not parts:
        return []
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = (sizes + 1).cumsum() - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint16)  # 0 parts the contexts
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text[:] = raw
    text += 1
    text[ends] = 0
    del raw
    match = RunIndex(text, length).matching_statistics()
    whole = lambda size: (np.zeros(1, np.int64), np.full(1, size - length))
    return [whole(size) if n > 1 and size >= length else _runs(np.flatnonzero(match[end - size : end - length + 1] >= length)) for n, end, size in zip(counts, ends.tolist(), sizes.tolist(), strict=True)]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(df, id_col, text_col)
    return rows.withColumn("key", key_of(F.col("doc_id"), F.col("text")))


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_codes(text: str) -> bytes:
    """CODE bytes for each word, so that repeats can be counted in words."""
    return b"".join([xxhash.xxh32_digest(w) for w in _utf8(text).split()])


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, encode: Callable[[str], bytes] = _utf8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeats in the bytes that ``encode`` makes of a text. (rows, candidates, marks): rows (key, doc_id, n_bytes, sha256) for all rows, candidates (key, doc_id, text) for
    those with a repeated anchor, marks (key, hits array<struct<firsts, spans>>): strings that begin at first to last of a span, from each of firsts on
    (``placed``)."""
    docs = _keyed(df, id_col, text_col)

    def anchors(part: pa.RecordBatch) -> dict:
        out: dict = {"n_bytes": [], "sha256": [], "hash": [], "times": []}
        for text in part.column("text").to_pylist():
            data = encode(text)
            value, times = np.unique(winnow(data, length, gram)[1].view(np.int64), return_counts=True)
            out["n_bytes"].append(len(data))
            out["sha256"].append(hashlib.sha256(data).hexdigest())
            out["hash"].append(value)
            out["times"].append(times)
        return out | {c: part.column(c) for c in ("key", "doc_id")}

    schema = "key binary, doc_id long, n_bytes long, sha256 string, hash array<long>, times array<long>"
    rows = stage(arrow_map(docs, anchors, schema), "anchors")
    # one row for each anchor of a text, however often it stands there
    held = rows.select("key", F.explode(F.arrays_zip("hash", "times")).alias("a")).select("key", F.col("a.hash").alias("hash"), F.col("a.times").alias("times"))
    often = stage(held.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1").select("hash"), "repeated-anchors")
    repeated = held.join(often, "hash").groupBy("key").agg(F.collect_set("hash").alias("hashes"))  # as many as a text has
    candidates = docs.join(repeated, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out: dict = {k: [] for k in ("key", "firsts", "hash", "name", "context")}
            for key, text, hashes in zip(*(part.column(c).to_pylist() for c in ("key", "text", "hashes")), strict=True):
                for (h, piece), firsts in contexts(encode(text), np.array(hashes, np.int64), length, gram).items():
                    out["key"].append(key)
                    out["firsts"].append(firsts)
                    out["hash"].append(h)
                    out["name"].append(hashlib.sha256(piece).digest()[:16])
                    out["context"].append(piece)
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    candidates = stage(candidates, "candidates")
    pieces = stage(candidates.mapInArrow(cut, "key binary, firsts array<long>, hash long, name binary, context binary"), "contexts")
    distinct = pieces.groupBy("hash", "name").agg(F.first("context").alias("context"), F.sum(F.size("firsts")).alias("n"))
    distinct = stage(distinct, "distinct-contexts")
    size = F.sum(F.octet_length("context") + 1)
    hot = stage(distinct.groupBy("hash").agg(size.alias("bytes")).where(F.col("bytes") > ANCHOR_BYTES).select("hash"), "hot-anchors")
    parts = distinct.select("hash", F.col("name").alias("part"), "context", "n")
    chain: list[DataFrame] = []  # (name, part, at): where the parts of a context, and the parts of parts, begin
    if not hot.isEmpty():
        cuts = stage(_repeated_parts(distinct.join(hot, "hash", "left_semi"), length), "hot-parts")
        chain.append(cuts.select("name", "part", "at"))
        found = stage(cuts.groupBy("hash", "part").agg(F.first("context").alias("context"), F.sum("n").alias("n")), "hot-parts-once")
        for longer in ((gram + length) // 2, length):
            large = stage(found.groupBy("hash").agg(size.alias("bytes")).where(F.col("bytes") > PART_BYTES).select("hash"), "large-anchors")
            if large.isEmpty():
                break
            split = stage(_split_parts(found.join(large, "hash", "left_semi"), length, longer), "split-parts")
            chain.append(split.select("name", "part", "at"))
            once = split.groupBy("hash", "part").agg(F.first("context").alias("context"), F.sum("n").alias("n"))
            found = stage(found.join(large, "hash", "left_anti").unionByName(once), "split-parts-once")
        parts = parts.join(hot, "hash", "left_anti").unionByName(found)
    total = parts.select(size).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def index(table: pa.Table) -> pa.Table:
        found = mark_shard(table.column("context").to_pylist(), table.column("n").to_pylist(), length)
        spans = [[{"first": a, "last": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in found]
        return pa.table({"part": table.column("part").combine_chunks(), "spans": pa.array(spans, span)}).filter(pa.array([bool(s) for s in spans], pa.bool_()))

    shard = F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int")
    marks = parts.select(shard.alias("shard"), "part", "context", "n").groupBy("shard").applyInArrow(index, "part binary, spans array<struct<first: long, last: long>>")
    for k, links in enumerate(reversed(chain)):  # a part's marks count from where it was cut
        marks = stage(marks, f"part-marks-{k}")
        moved = F.transform("spans", lambda s: F.struct((s.first + F.col("at")).alias("first"), (s.last + F.col("at")).alias("last")))
        inner = links.join(marks, "part").select("name", moved.alias("spans")).groupBy("name").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        marks = marks.join(links.select("part").distinct(), "part", "left_anti").unionByName(inner.withColumnRenamed("name", "part"))
    marks = marks.withColumnRenamed("part", "name")
    marks = pieces.select("name", "key", "firsts").join(marks, "name").groupBy("key").agg(F.collect_list(F.struct("firsts", "spans")).alias("hits"))
    return rows.select("key", "doc_id", "n_bytes", "sha256"), candidates.select("key", "doc_id", "text"), marks


def placed(hits: list[dict]) -> list[tuple[int, int]]:
    """(first, last) in the text of the spans of its contexts."""
    return [(at + s["first"], at + s["last"]) for hit in hits for s in hit["spans"] for at in hit["firsts"]]


def _split_parts(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, name, part, at, context, n): the contexts of parts (hash, part, context, n), cut by the anchors that strings
    of ``gram`` bytes give; ``hash`` joins the old and the new anchor. Every string of ``length`` bytes is in one of them."""

    def cut(part: pa.RecordBatch) -> dict:
        out = []
        for h, context in zip(part.column("hash").to_pylist(), part.column("context").to_pylist(), strict=True):
            _, value, first, last = winnow(context, length, gram)
            mixed = (value ^ np.uint64((h * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))).view(np.int64)
            out.append([{"hash": v, "at": a, "context": (piece := context[a : b + length]), "part": hashlib.sha256(piece).digest()[:16]} for v, a, b in zip(mixed.tolist(), first.tolist(), last.tolist(), strict=True)])
        return {"name": part.column("part"), "n": part.column("n"), "cuts": out}

    done = arrow_map(parts, cut, "name binary, n long, cuts array<struct<hash: long, at: long, context: binary, part: binary>>", rows=64)
    return done.select("name", "n", F.explode("cuts").alias("c")).select("c.hash", "name", "c.part", "c.at", "c.context", "n")


def _repeated_parts(contexts_: DataFrame, length: int) -> DataFrame:
    """(hash, name, part, at, context, n): the parts of the contexts of a frequent anchor in which every string may be
    repeated.

    A string whose hash no other string shares is not repeated: it is left out, and with it nearly all that tells the
    contexts of a common passage apart, so that their parts are few different ones. The index then decides.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            a = [rolling(np.frombuffer(piece, np.uint8), length).view(np.int64) for piece in part.column("context").to_pylist()]
            n = np.repeat(part.column("n").to_numpy(), [len(x) for x in a])
            if a:
                values, place = np.unique(np.concatenate(a), return_inverse=True)  # pre-summed
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(place, n).astype(np.int64))], ["string", "n"])

    seen = contexts_.select("context", "n").mapInArrow(strings, "string long, n long").groupBy("string").agg(F.sum("n").alias("n"))
    seen = stage(seen.where("n > 1").select("string"), "repeated-strings")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            a = [rolling(np.frombuffer(piece, np.uint8), length).view(np.int64) for piece in part.column("context").to_pylist()]
            many = np.array([len(x) for x in a], np.int64)
            if a:
                names = part.column("name").take(pa.array(np.repeat(np.arange(len(a)), many)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([np.arange(k) for k in many])), pa.array(np.concatenate(a))], ["name", "first", "string"])

    kept = contexts_.select("name", "context").mapInArrow(places, "name binary, first long, string long").join(seen, "string").groupBy("name").agg(F.collect_list("first").alias("firsts"))

    def cut(part: pa.RecordBatch) -> dict:
        spans, contexts = [], part.column("context").to_pylist()
        for firsts in part.column("firsts").to_pylist():
            spans.append(list(zip(*(x.tolist() for x in _runs(np.sort(np.array(firsts, np.int64)))), strict=True)))
        return {c: part.column(c) for c in ("hash", "name", "n")} | {"cuts": [[{"at": a, "context": c[a : b + length], "part": hashlib.sha256(c[a : b + length]).digest()[:16]} for a, b in at] for c, at in zip(contexts, spans, strict=True)]}

    done = arrow_map(contexts_.join(kept, "name"), cut, "hash long, name binary, n long, cuts array<struct<at: long, context: binary, part: binary>>", rows=256)
    return done.select("hash", "name", "n", F.explode("cuts").alias("c")).select("hash", "name", F.col("c.part").alias("part"), F.col("c.at").alias("at"), F.col("c.context").alias("context"), "n")


def removed_spans(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that begin at first to last; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters, so that what stays is text."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else (another text, the same text, a
    repeated row) is removed, in all places. Rows of null ids count like others; other columns are not read; long texts are
    winnowed whole, in blocks. kept_text is what stays, in whole characters, where something was removed;
    null elsewhere, where the text is as it was. Null and empty texts, and those shorter than ``length``, stay whole; an
    empty table gives no rows.
    """
    rows, candidates, marks = find_repeats(df, id_col, text_col, length, gram)
    marked = candidates.join(marks, "key")

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept_text")}
        for text, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            gone = removed_spans(placed(hits), length)
            kept = without(data, gone)
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(without(data, whole_characters(data, gone)).decode("utf-8", "replace"))
        return out | {"key": part.column("key")}

    # rows of the same key are equal and have equal results: one of them is enough for the join
    done = arrow_map(marked, make, "key binary, n_removed long, n_spans long, kept_sha256 string, kept_text string", rows=128)
    done = stage(done, "removed").dropDuplicates(["key"])
    return rows.join(done, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        "kept_text",
        "key",
    )


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """(key, kept_text) of the texts that hold a run of ``words`` words which also starts anywhere else, without all such
    runs and the white space after them. White space between words may differ."""
    _, candidates, marks = find_repeats(df, id_col, text_col, words * CODE, encode=word_codes)

    def make(part: pa.RecordBatch) -> dict:
        kept = []
        for text, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True):
            data = _utf8(text)
            # runs that begin with a word: bytes may match between words, where all but one of the words are equal
            whole = [(a, b) for first, last in placed(hits) if (a := -(-first // CODE)) <= (b := last // CODE)]
            at = [m.start() for m in _TOKEN.finditer(data)] + [len(data)] if whole else []
            kept.append(without(data, [(at[a], at[b]) for a, b in removed_spans(whole, words)]).decode("utf-8", "replace") if whole else None)
        return {"key": part.column("key"), "kept_text": kept}

    return arrow_map(candidates.join(marks, "key"), make, "key binary, kept_text string", rows=128)
