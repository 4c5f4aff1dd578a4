"""Operator 9: language-model scores by context-tree weighting, beside an add-one word model.

A text is coded as one stream of bytes: its lower-case words, each closed by an end byte, and one last end. The context
of a byte is the DEPTH bytes before it, over the ends of words; DEPTH end bytes stand before a text. Every different
(context, byte) is counted once over the corpus and scored once. The tree keeps every context that MIN_COUNT training
bytes follow, whatever their share. It is never in one place: its branches are cut by the last STEM + 1 bytes of the
context and weighed in shards; the contexts of at most STEM bytes are weighed on the driver and broadcast. Frequent
keys' and words' scores are broadcast; the others' are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import slices, stage, texts
from quantloom.llm.context_tree import DEPTH, Branches, Table, grams, trunk

#: A context is kept if at least so many training bytes follow it.
MIN_COUNT = 3
#: Bytes of context that the driver's part of the tree has: at most 2^16 contexts with 255 binary decisions each, and no
#: more than the corpus has different three-byte strings.
STEM = 2
#: Keys that a shard of the tree should hold.
SHARD_KEYS = 150_000
#: Words and keys whose scores are broadcast, at most; all others are joined.
HEAD_WORDS, HEAD_GRAMS = 1 << 16, 1 << 19
#: Different words or keys that a task counts before it hands the counts on, and bytes of text that it sorts at once.
FLUSH_WORDS, FLUSH_GRAMS, CHUNK_BYTES = 250_000, 1_000_000, 2 << 20
LOG10_2 = float(np.log10(2.0))


def held_out(doc_id: Column) -> Column:
    """Rows not learnt from: crc32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z alone) words of a text, parted by the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def stream_of(words: list[bytes]) -> bytes:
    """The coded bytes: each word and an end byte, then one last end."""
    return b" ".join([*words, b" "])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n: in all documents, c: in training documents); the end of a text is an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for held, mine in sums.items():
                n = pa.array(mine.values(), pa.int64())
                words = pa.array(list(mine), pa.binary())
                mine.clear()
                yield pa.RecordBatch.from_arrays([words, n, pa.array(np.zeros(len(n), np.int64)) if held else n], ["word", "n", "c"])

        for part in slices(batches, 64):
            for text, held in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist(), strict=True):
                sums[held].update(words_of(text))
                sums[held][b""] += 1  # the end: no word is empty
            if sum(map(len, sums.values())) > FLUSH_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(key, n: in all documents, c: in training documents) of every byte with its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[bytes]] = {False: [], True: []}
        sums: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def merge(held: bool) -> int:
            keys, at = np.unique(np.concatenate([k for k, _ in sums[held]]), return_inverse=True)
            sums[held] = [(keys, np.bincount(at, np.concatenate([n for _, n in sums[held]]), len(keys)).astype(np.int64))]
            return len(keys)

        def sort(held: bool) -> None:
            sums[held].append(np.unique(grams(waiting[held])[0], return_counts=True))
            waiting[held] = []

        def out(held: bool) -> Iterator[pa.RecordBatch]:
            for keys, n in sums[held]:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(n * 0 if held else n)], ["key", "n", "c"])
            sums[held] = []

        size = {False: 0, True: 0}
        for part in slices(batches, 64):
            for text, held in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist(), strict=True):
                waiting[held].append(stream_of(words_of(text)))
                size[held] += len(waiting[held][-1])
                if size[held] > CHUNK_BYTES:
                    size[held] = 0
                    sort(held)
                    if sum(len(k) for k, _ in sums[held]) > FLUSH_GRAMS and merge(held) > FLUSH_GRAMS // 2:
                        yield from out(held)
        for held in sums:
            sort(held)
            merge(held)
            yield from out(held)

    return docs.mapInArrow(run, "key long, n long, c long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def score_grams(counts: DataFrame) -> DataFrame:
    """(key, n, bits) for all counted keys: their code length by the frozen tree. All keys of a stem meet in one shard."""
    shards = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD_KEYS))
    stem = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * (STEM + 1)) - 1)
    dealt = counts.repartition(shards, stem)

    def branches(batches: Iterator[pa.RecordBatch]) -> tuple[Branches, pa.Table] | None:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        return table and (Branches(table.column("key").to_numpy().view(np.uint64), table.column("c").to_numpy(), MIN_COUNT, STEM), table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := branches(batches):
            top = got[0].levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(top.names.view(np.int64)), *map(pa.array, (top.zeros, top.ones, *got[0].sums))], ["name", *columns])

    columns = ["zeros", "ones", "child_zeros", "child_ones", "below"]
    parts = dealt.mapInArrow(weigh, "name long, " + ", ".join(f"{c} double" for c in columns))
    rows = parts.groupBy("name").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("name").toArrow()
    zeros, ones, *sums = (rows.column(c).to_numpy() for c in columns)
    shared = counts.sparkSession.sparkContext.broadcast(trunk(rows.column("name").to_numpy().view(np.uint64), zeros, ones, tuple(sums), MIN_COUNT, STEM))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := branches(batches):
            table = got[1].select(["key", "n"]).append_column("bits", pa.array(got[0].bits(shared.value)))
            yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)

    return dealt.mapInArrow(code, "key long, n long, bits double")


def head_of(table: DataFrame, room: int) -> DataFrame:
    """The most frequent rows by ``n``, ``room`` at most; which rows are broadcast changes no result."""
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = sorted((r[0], r[1]) for r in table.groupBy(level).count().collect())  # one row for each quarter of a power of 2
    least = sizes[-1][0] + 1 if sizes else 0
    for k, m in reversed(sizes):
        if m > room:
            break
        least, room = k, room - m
    return table.where(level >= least)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    base_score: sum over tokens (words and one end) of log10((c + 1) / (N + V + 1)). score: log10 of the tree's
    probability of the text's coded bytes. Null texts count as empty ones: the end alone. Words that no training text
    has are scored by their bytes. Repeated rows are learnt from as often as they come and give equal rows. Without any
    training row every bit has probability a half; an empty table gives no rows. Rows of null ids are learnt from, other
    columns are not read, long texts are counted and scored whole.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    words = stage(count_words(docs), "words")
    train = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = int(train[0]), int(train[1])
    coded = stage(score_grams(stage(count_grams(docs), "grams")), "scored-grams")
    top = head_of(words, HEAD_WORDS).select("word", "c").toArrow()
    often = head_of(coded, HEAD_GRAMS).select("key", "bits").toArrow()
    shared = spark.sparkContext.broadcast((top.column("word").to_pylist(), top.column("c").to_numpy(), often.column("key").to_numpy(), often.column("bits").to_numpy()))
    del top, often
    index: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, keys, bits = shared.value
        if not index:
            index["words"] = {name: i for i, name in enumerate(names)}
            index["grams"] = Table(keys.view(np.uint64) + np.uint64(1))
        get, find = index["words"].get, index["grams"].find
        value = np.stack([np.log10(c + 1.0), c > 0], axis=1)
        for part in slices(batches, 32):
            n_tokens, n_bytes, sums, streams, rare, rare_n, sizes = [], [], [], [], [], [], [0]
            for text in part.column("text").to_pylist():
                found = words_of(text)
                streams.append(stream_of(found))
                found.append(b"")
                at = [get(w, -1) for w in found]
                other = Counter([w for w, i in zip(found, at, strict=True) if i < 0])
                there = np.array(at, np.int64)
                there = there[there >= 0]
                sums.append(value[there].sum(0) if len(value) else np.zeros(2))
                rare += other
                rare_n += other.values()
                sizes.append(len(rare))
                n_tokens.append(len(found))
                n_bytes.append(len(streams[-1]))
            total2 = np.array(sums).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(rare_n, pa.int64())], ["word", "k"])
            key, first, _ = grams(streams)
            at = find(key + np.uint64(1))
            code = np.append(bits, 0.0)[at]  # 0 for those that are joined
            new = np.flatnonzero(at < 0)
            cut = np.searchsorted(new, np.append(first, len(key)))
            kinds = [np.unique(key[new[a:b]], return_counts=True) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            more = pa.StructArray.from_arrays([pa.array(np.concatenate([k for k, _ in kinds]).view(np.int64)), pa.array(np.concatenate([n for _, n in kinds]).astype(np.int64))], ["key", "k"])
            ends = np.cumsum([0, *(len(k) for k, _ in kinds)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("doc_id", "held_out")),
                    *(pa.array(x, pa.int64()) for x in (n_tokens, n_bytes, total2[:, 1].astype(np.int64))),
                    *(pa.array(x) for x in (total2[:, 0], np.add.reduceat(code, first))),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), more),
                ],
                ["doc_id", "held_out", "n_tokens", "n_bytes", "known", "logs", "bits", "rare", "grams"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, logs double, bits double, rare array<struct<word: binary, k: long>>, grams array<struct<key: long, k: long>>"
    parts = stage(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "texts")  # the row number is written, so it stays
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    k = F.col("k")
    more = rare.join(words.select("word", "c"), "word").groupBy("row").agg(F.sum(k * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("more_known"))
    other = parts.select("row", F.explode("grams").alias("r")).select("row", F.col("r.key").alias("key"), F.col("r.k").alias("k"))
    joined = other.join(coded.select("key", F.col("bits").alias("b")), "key").groupBy("row").agg(F.sum(k * F.col("b")).alias("more_bits"))
    base = float(np.log10(total + kinds + 1.0))
    zero = F.lit(0.0)
    bits = F.col("bits") + F.coalesce("more_bits", zero)
    return parts.drop("rare", "grams").join(more, "row", "left").join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (-bits * F.lit(LOG10_2)).alias("score"),
        "n_bytes",
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
