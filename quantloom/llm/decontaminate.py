"""Operator 12: benchmark decontamination by winnowing.

Of the hashes of k words in every window of words, the least one is kept, in documents and benchmark items alike. Any run
of words that both share and that is as long as a window has then a kept hash in common, wherever it stands. Kept hashes
of the documents are joined with those of the benchmark; each hit is extended to the windows of words around it, which are
compared with the benchmark's windows by 128-bit digests of their text.

A sieve of the benchmark's kept hashes, of bounded size, goes to all tasks, so that nearly all hashes that the benchmark
has not are dropped before they are sent. It never drops one that the benchmark has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import key_of, stage, texts
from quantloom.llm.word_hash import LOWER, Sieve, run_codes, sieve_of, text_bytes, text_slices, word_codes, word_places

#: Words of a window.
WORDS = 10
#: Bytes of words: digits, letters, and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def gram_of(length: int) -> int:
    """Words of a hash for windows of ``length`` words."""
    return (length + 1) // 2


def kept_runs(codes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the least hash of gram_of(length) words in each window of ``length`` words of one text."""
    gram = gram_of(length)
    if len(codes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = run_codes(codes, gram)
    many = len(codes) - length + 1
    best, at = hashes[:many].copy(), np.zeros(many, np.int8)
    for j in range(1, length - gram + 1):  # of equal ones the first
        less = hashes[j : j + many] < best
        best[less] = hashes[j : j + many][less]
        at[less] = j
    whole = doc[:many] == doc[length - 1 :]
    place = (np.arange(many) + at)[whole]
    place = place[np.append(True, np.diff(place) > 0)] if len(place) else place  # places never move back
    return place, hashes[place]


def _digest(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, length: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join([data[a:b].tobytes() for a, b in zip(start[at : at + length].tolist(), end[at : at + length].tolist(), strict=True)]))


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, cut = text_bytes(part.column("text"))
    start, end = word_places(data, cut, _WORD)
    many = np.diff(np.searchsorted(start, cut))
    return LOWER[data], start, end, word_codes(data, start, end), np.repeat(np.arange(part.num_rows), many), many


def _items(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item string, length int, kept array<long>, windows array<binary>) of each item that has words."""
    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), F.coalesce(benchmark[text_col], F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=1 << 20):
            data, start, end, codes, _, many = _words(part)
            first = np.append(0, many.cumsum())
            names = part.column("item").to_pylist()
            out: dict = {"item": [], "length": [], "kept": [], "windows": []}
            for k in np.flatnonzero(many).tolist():
                length, at, n = min(words, int(many[k])), int(first[k]), int(many[k])
                _, kept = kept_runs(codes[at : at + n], np.zeros(n, np.int8), length)
                out["item"].append(names[k])
                out["length"].append(length)
                out["kept"].append(kept.view(np.int64))
                out["windows"].append([_digest(data, start, end, i, length) for i in range(at, at + n - length + 1)])
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return rows.mapInArrow(make, "item string, length int, kept array<long>, windows array<binary>")


def _candidates(docs: DataFrame, lengths: list[int], sieve: Sieve) -> DataFrame:
    """(key, doc_id, n_words, hits): of each kept hash that passes the sieve, the windows around it and their digests."""
    shared = docs.sparkSession.sparkContext.broadcast((sieve.bits, lengths))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        known = Sieve(bits)
        digest = pa.list_(pa.binary())
        kind = pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("first", pa.int64()), ("windows", digest)])
        for part in text_slices(batches):
            data, start, end, codes, doc, many = _words(part)
            first = np.append(0, many.cumsum())
            hits: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for length in sizes:
                place, kept = kept_runs(codes, doc, length)
                found = np.flatnonzero(known.has(kept))
                for p, h in zip(place[found].tolist(), kept[found].view(np.int64).tolist(), strict=True):
                    k = int(doc[p])
                    low, high = max(int(first[k]), p - (length - gram_of(length))), min(p, int(first[k + 1]) - length)
                    hits[k].append({"hash": h, "length": length, "first": low - int(first[k]), "windows": [_digest(data, start, end, i, length) for i in range(low, high + 1)]})
            arrays = [part.column("key"), part.column("doc_id"), pa.array(many, pa.int64()), pa.array(hits, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_words", "hits"])

    return docs.mapInArrow(make, "key binary, doc_id long, n_words long, hits array<struct<hash: long, length: int, first: long, windows: array<binary>>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans.

    Words are runs of digits, letters and characters beyond ASCII, in lower case. A window is ``words`` consecutive words
    of an item, or all of an item of fewer. A word inside any occurrence of a window is hit. n_items counts the ids of the
    items that have a window in the text; items_sha256 is the digest of those ids, sorted as texts, joined by commas.
    hit_spans are the hit words as runs (first, after the last), from 0.

    Null and empty texts have no words and no hits; items without words have no windows. Items of a null id hit words, but
    are not counted. Rows of one item id are one item, repeated rows of documents give equal rows, whatever their ids. Other
    columns are not read. An empty benchmark hits nothing; empty documents give no rows. Long texts are taken whole, alone.
    """
    items = stage(_items(benchmark, item_col, text_col, words), "benchmark")
    runs = stage(items.select("length", F.explode("kept").alias("hash")).distinct(), "benchmark-hashes")
    lengths = [r.length for r in runs.select("length").distinct().orderBy("length").collect()]  # at most ``words`` rows
    sieve = sieve_of(runs, "hash", runs.count())
    rows = texts(docs, id_col, text_col)
    found = stage(_candidates(rows.withColumn("key", key_of(rows.doc_id, rows.text)), lengths, sieve), "candidates")

    held = items.select("item", F.explode("windows").alias("window")).distinct()
    # windows that the same items hold are one class, named by a digest of that set, so that no window's items are gathered
    two = [F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64(F.lit(s), "item"))).cast("string") for s in (1, 2)]
    name = F.md5(F.concat_ws(",", F.count("item").cast("string"), *two))
    windows = stage(held.groupBy("window").agg(name.alias("class")), "windows")
    first = windows.groupBy("class").agg(F.min("window").alias("window"))
    members = stage(first.join(held.where("item is not null"), "window").select("class", "item"), "class-items")

    hits = found.select("key", F.explode("hits").alias("h")).select("key", "h.*")
    hits = hits.join(runs, ["hash", "length"], "left_semi").select("key", "length", "first", F.posexplode("windows").alias("step", "window"))
    near = hits.join(windows, "window").select("key", (F.col("first") + F.col("step")).alias("start"), "length", "class")
    each = near.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("at"), F.sort_array(F.collect_set("class")).alias("classes"))
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<first:bigint,after:bigint>>"),
        lambda done, x: F.when(
            F.coalesce(F.try_element_at(done, F.lit(-1))["after"] >= x["start"], F.lit(False)),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["after"], x["start"] + x["length"]).alias("after"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("first"), (x["start"] + x["length"]).alias("after"))))),
    )
    each = stage(each.select("key", merged.alias("hit_spans"), "classes", F.md5(F.array_join("classes", ",")).alias("set")), "hit-documents")
    sets = each.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    listed = sets.join(members, "class").select("set", "item").distinct().groupBy("set").agg(F.sort_array(F.collect_list("item")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    known = each.join(listed, "set", "left").select("key", "hit_spans", "n_items", "items_sha256")
    total = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    out = found.select("key", "doc_id", "n_words").join(known, "key", "left").withColumn("n_hit", F.coalesce(total, F.lit(0).cast("long")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("hit_spans", F.array().cast("array<struct<first:bigint,after:bigint>>")).alias("hit_spans"),
    )


#: The same result for DuckDB, by comparing all windows.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
windows AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
hits AS (SELECT DISTINCT x.r, x.i, x.n, k.item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))) x JOIN windows k ON k.s = x.s AND k.n = x.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
