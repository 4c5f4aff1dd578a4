"""Operator 7: packing into sequences by cutting-stock column generation.

Every document's ids are cut into full pieces of a sequence's length and one remainder, where they are made: no ids
are moved. The histogram of piece lengths goes to the driver, which puts lengths into classes, solves the cutting-stock
program over them and sends back a table of slots. Pieces are ranked within their class, in salted parts, and a piece's
rank finds its slot.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, stage, texts
from quantloom.llm.cutting_stock import class_edges, plan
from quantloom.llm.word_hash import text_slices

CAPACITY, END_ID = 1024, 0
#: Parts in which the pieces of one class are ranked; a part's first rank comes from the counts of those before.
RANK_PARTS = 256
#: Words of an age whose ids a worker keeps, words that the library encodes at once, and bytes of text that are cut at once.
KEPT_WORDS, WORDS_AT_ONCE, SLICE_BYTES = 150_000, 4096, 1 << 20
#: Marks that may end a word, the letters that they may follow, and ends of words whose ids a worker keeps.
PUNCTUATION, LETTER, KEPT_TAILS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$", 65_536
_LOADED: dict[str, TextIds] = {}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class TextIds:
    """Ids of whole texts by the tokenizers library's object of a file, as it is.

    A byte-level pre-tokenizer puts a space only at the front of a piece, and white space joins nothing but white space.
    So a piece always ends between a word and a single space or line feed after it, and the ids of a text are those of its
    words with what leads them, one after the other. Arrow cuts texts into words and numbers the different ones; each
    is encoded once by the library, and numpy lays out the ids. ASCII marks at a word's end are pieces of their own
    after a letter, so they and the word before them are encoded apart. Where that does not hold the library encodes
    the whole text: texts with a space or line feed beside other white space, texts that hold an added token, and all
    texts if the file has a normalizer, a post-processor or another pre-tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        front = made.get("pre_tokenizer") or {}
        self.by_word = front.get("type") == "ByteLevel" and front.get("use_regex", True) and not front.get("add_prefix_space", True) and not made.get("normalizer") and not made.get("post_processor")
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.kept = 0  # words of an age, if not KEPT_WORDS
        self.words: dict[str, bytes] = {}  # ids of words led by a space, or by the line feed that they begin with, in two ages
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}  # ids of marks at the ends of words

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words. An empty word, or one that ends in white space, has none: b'' marks that its text must
        be encoded whole."""
        if len(self.words) > (self.kept or KEPT_WORDS):
            self.words, self.older = {}, self.words
        found = list(map(self.words.get, words))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in gaps:
            if (x := self.older.get(w := words[i])) is None and w and not w[-1].isspace():
                new.append(w)
            else:
                self.words[w] = x or b""
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            self.words.update(zip(part, self._encoded([w if w[0] == "\n" else " " + w for w in part]), strict=True))
        for i in gaps:
            found[i] = self.words[words[i]]
        return found

    def _ids_of_tails(self, tails: list[str]) -> list[bytes]:
        """Ids of different marks at the ends of words; b'' of none."""
        new = [x for x in tails if x not in self.tails]
        if len(self.tails) + len(new) > KEPT_TAILS:
            self.tails, new = {}, tails
        self.tails.update(zip(new, self._encoded(new), strict=True))
        return list(map(self.tails.get, tails))

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.full(len(column), not self.by_word)
        for a in self.added:
            whole |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        if whole.all():
            return self._encoded(column.to_pylist())
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        edges = cut.offsets.to_numpy()
        numbered = cut.values.dictionary_encode()
        word = numbered.dictionary
        core = pc.utf8_rtrim(word, PUNCTUATION)
        core = pc.if_else(pc.match_substring_regex(core, LETTER), core, word)  # no piece reaches from a letter to a mark after it
        size = pc.binary_length(core).to_numpy()
        longer = np.flatnonzero(size < pc.binary_length(word).to_numpy())
        ended = _strings(word.take(pa.array(longer)))
        tails, which = np.unique([w.encode()[n:].decode() for w, n in zip(ended, size[longer].tolist(), strict=True)], return_inverse=True)
        core = core.dictionary_encode()
        heads = _strings(cut.values.take(pa.array(edges[:-1])))
        one = np.diff(edges) == 1
        whole |= [not head or (head[-1].isspace() and not alone) for head, alone in zip(heads, one.tolist(), strict=True)]
        # a row for each different core and tail, then one for the first word of each text, which nothing leads
        cores = _strings(core.dictionary)
        rows = [*self._ids_of(cores), *self._ids_of_tails(tails.tolist()), *self._encoded(heads), b""]
        tail = np.full(len(word), len(rows) - 1)
        tail[longer] = which + len(cores)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        code = numbered.indices.to_numpy()
        both = np.empty((len(code), 2), np.int64)
        both[:, 0] = core.indices.to_numpy()[code]
        both[:, 1] = tail[code]
        both[edges[:-1], 0] = np.arange(len(rows) - 1 - len(heads), len(rows) - 1)
        both[edges[:-1], 1] = len(rows) - 1
        many = sizes[both]
        whole |= np.minimum.reduceat(many[:, 0], edges[:-1]) == 0
        both, many = both.ravel(), many.ravel()
        ends = many.cumsum()
        starts = (sizes.cumsum() - sizes)[both] - (ends - many)
        laid = np.frombuffer(b"".join(rows), "<u4")[np.repeat(starts, many) + np.arange(ends[-1])].tobytes()
        at = 4 * np.append(0, ends)[2 * edges]
        out = [laid[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        others = np.flatnonzero(whole)
        for i, x in zip(others.tolist(), self._encoded(column.take(pa.array(others)).to_pylist()), strict=True):
            out[i] = x
        return out


def load(path: str) -> TextIds:
    """One for each worker."""
    if path not in _LOADED:
        _LOADED[path] = TextIds(path)
    return _LOADED[path]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, kept_words: int = 0, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces and a remainder of every document's ids and end id."""

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        end = END_ID.to_bytes(4, "little")
        ids = load(tokenizer_path)
        ids.kept = kept_words
        whole = [x for texts in text_slices(iter([part]), most=slice_bytes) for x in ids.ids(texts.column("text"))]
        for doc_id, packed in zip(part.column("doc_id").to_pylist(), whole, strict=True):
            packed += end
            n = len(packed) // 4
            for start in range(0, n, capacity):
                stop = min(n, start + capacity)
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(stop - start)
                out["ids_crc32"].append(zlib.crc32(packed[4 * start : 4 * stop]))
                out["doc_tokens"].append(n)
        return out

    return arrow_map(texts(df, id_col, text_col), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", rows=1024)


def slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence, place) for each class of each pattern."""
    rows, sequence = [], 0
    rank = dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, capacity):
        place = 0
        for kind, n in sorted(pattern.items(), reverse=True):
            rows.append((kind, rank[kind], rank[kind] + n * times, n, sequence, place))
            rank[kind] += n * times
            place += n
        sequence += times
    if rank != histogram:
        raise AssertionError("the plan does not hold exactly the pieces")
    return rows


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, kept_words: int = 0, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Repeated rows are packed as often as they come; ties within a class go
    to the smaller (doc_id, start). Rows of null ids are packed like others, other columns are not read, and long texts
    are cut like all. An empty table gives no rows. The histogram has a row for each length up to ``capacity`` and the
    slot table a few for each class (their sizes don't depend on the corpus), so the one is collected and the other
    broadcast. A job whose workers hold little else may keep more words (``kept_words``, about 200 bytes each, in two ages)
    and cut more text at once (``slice_bytes``): both save time alone.
    """
    spark = df.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_PARTS)).cast("int")
    cut = stage(pieces(df, tokenizer_path, id_col, text_col, capacity, kept_words, slice_bytes).withColumn("part", part), "pieces")
    sizes = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")  # capacity * RANK_PARTS rows at most
    lengths = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    edges = class_edges(lengths)
    histogram = dict.fromkeys(edges, 0)
    for length, n in lengths.items():
        histogram[edges[bisect_left(edges, length)]] += n
    longest = edges[-1] if edges else 0
    kind = F.element_at(F.array(*[F.lit(edges[bisect_left(edges, k)]) for k in range(1, longest + 1)] or [F.lit(0)]), F.col("length").cast("int"))
    cut, sizes = cut.withColumn("kind", kind), sizes.withColumn("kind", kind).groupBy("kind", "part").agg(F.sum("n").alias("n"))
    table = spark.createDataFrame(slots(histogram, capacity), "kind int, low long, high long, each long, sequence long, place long")
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("kind", "part", F.coalesce(before, F.lit(0)).alias("base"))
    order = Window.partitionBy("kind", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(firsts), ["kind", "part"]).withColumn("k", F.col("k") + F.col("base"))
    here = (ranked.kind == table.kind) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high"))
    step = F.col("k") - F.col("low")
    placed = ranked.join(F.broadcast(table), here).select(
        *("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(step, F.col("each"))).alias("place"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("place")
