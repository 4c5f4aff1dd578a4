"""Operator 1: media columns by content-defined payload chunking.

A text becomes a media file (a short header and one unsigned 8-bit sample for each payload byte). A rolling gear hash
over the file's bytes chooses the cuts, so equal stretches give equal chunks wherever they stand. Chunks are known by
their SHA-256 digest; Spark keeps each digest's bytes once. A media file is stored as the ordered list of its digests;
reading it back joins that list with the chunks, puts them in order and verifies every digest and the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, sample_rows, stage, texts

UNIT = 64
MAGIC = b"QLM1"
HEADER = struct.Struct("<4sQQ")
LEAST, MOST, CUT_BITS = 2048, 65536, 13
#: Chunks are kept compressed, with a dictionary made from the first SAMPLE_BYTES of SAMPLE_ROWS texts.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY, LEVEL = 512, 4096, 32768, 6
#: A digest found more often than this share of the rows is kept in SALTS copies; the MOST_HOT most frequent at most.
HOT_SHARE, SALTS, MOST_HOT = 1e-3, 64, 4096


def _gear() -> np.ndarray:
    """The 256 random words of the gear hash, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)


GEAR = _gear()


def media_of(text: str) -> bytes:
    """The media file of a text: header (magic, bytes of the text, samples), then 8-bit samples."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return HEADER.pack(MAGIC, len(raw), size) + raw + bytes(size - len(raw))


def payload_of(media: bytes) -> tuple[int, bytes]:
    """(bytes of the text, padded payload) of a media file."""
    magic, n, size = HEADER.unpack_from(media)
    if magic != MAGIC or len(media) != HEADER.size + size:
        raise ValueError("not a whole media file")
    return n, media[HEADER.size :]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has CUT_BITS zero bits, LEAST to MOST bytes apart."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):  # sums over 2, 4, ... 32 bytes, each byte shifted once more for each one after it
        w = 1 << k
        if n > w:
            h[w:] += h[:-w].copy() << np.uint32(w)
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, start = [], 0
    while n - start > LEAST:
        i = int(np.searchsorted(at, start + LEAST))
        end = int(at[i]) if i < len(at) else n
        end = min(end, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def dictionary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A compression dictionary from a bounded sample; b'' if the sample is too small for one."""
    rows = sample_rows(texts(df, id_col, text_col), "doc_id", SAMPLE_ROWS).select(F.substring("text", 1, SAMPLE_BYTES).alias("t"))
    sample = [r[0].encode("utf-8", "surrogatepass") for r in rows.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bytes | None = None) -> DataFrame:
    """Ordered chunk lists: (doc_id, media_key, seq, n_chunks, digest, media_sha256[, packed]) for every row's media file.

    media_key is the start of the file's digest, which stands in full beside the first chunk alone. Chunk bytes come
    with them if a dictionary (or b'') is given.
    """
    with_bytes = words is not None

    def make(part: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **_codec(words or b"")).compress
        out: dict = {k: [] for k in ("doc_id", "media_key", "seq", "n_chunks", "digest", "media_sha256", *(["packed"] if with_bytes else []))}
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            media = media_of(text)
            whole, start, ends = hashlib.sha256(media).digest(), 0, cuts(media)
            for seq, end in enumerate(ends):
                piece = media[start:end]
                out["doc_id"].append(doc_id)
                out["media_key"].append(int.from_bytes(whole[:8], "big", signed=True))
                out["seq"].append(seq)
                out["n_chunks"].append(len(ends))
                out["digest"].append(hashlib.sha256(piece).digest())
                out["media_sha256"].append(None if seq else whole)
                if with_bytes:
                    out["packed"].append(squeeze(piece))
                start = end
        return out

    schema = "doc_id long, media_key long, seq int, n_chunks int, digest binary, media_sha256 binary" + ", packed binary" * with_bytes
    return arrow_map(texts(df, id_col, text_col), make, schema, rows=128)


def hot_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests to salt, most frequent first: MOST_HOT rows at most, however large the table.

    Salting decides where rows meet, not what comes out, so the bound drops nothing: a digest beyond it has less than
    1/MOST_HOT of all chunks.
    """
    counts = chunks(df, id_col, text_col).groupBy("digest").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > F.lit(HOT_SHARE) * df.count()).where("n > 1000")
    return stage(hot.orderBy(F.desc("n"), "digest").limit(MOST_HOT).select("digest"), "digests")


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, bytes]:
    """(ordered chunk lists, chunk store, its dictionary). The store has each (digest, salt) once; salt is 0 but for hot digests."""
    hot = hot_digests(df, id_col, text_col).withColumn("hot", F.lit(True))
    words = dictionary(df, id_col, text_col)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "media_key"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = lambda rows: rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).drop("hot")  # noqa: E731  MOST_HOT digests at most
    kept = salted(chunks(df, id_col, text_col, words)).groupBy("digest", "salt").agg(F.first("packed").alias("packed"))
    return salted(chunks(df, id_col, text_col)), kept, words  # the lists are cut without bytes: nothing is packed for them


def read_back(lists: DataFrame, kept: DataFrame, words: bytes) -> DataFrame:
    """(doc_id, media) rebuilt from chunk lists and chunk store, every digest verified; a gap or a difference raises."""
    placed = lists.join(kept, ["digest", "salt"], "left")
    placed = placed.repartition("doc_id", "media_key").sortWithinPartitions("doc_id", "media_key", "seq")
    schema = "doc_id long, media binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_codec(words)).decompress
        key, got, n_chunks, copies, digest_of_all = None, [], 0, 0, b""
        ids: list = []
        media: list[bytes] = []

        def close() -> None:
            if key is None:
                return
            whole = b"".join(got)
            if len(got) != n_chunks or hashlib.sha256(whole).digest() != digest_of_all:
                raise ValueError(f"document {key[0]} was not rebuilt whole")
            ids.extend([key[0]] * copies)
            media.extend([whole] * copies)

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], schema=arrow)
            ids.clear()
            media.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "media_key", "seq", "n_chunks", "digest", "media_sha256", "packed")]
            for doc_id, own, seq, n, digest, whole, packed in zip(*columns, strict=True):
                if (doc_id, own) != key:
                    close()
                    key, got, n_chunks, copies, digest_of_all = (doc_id, own), [], n, 0, whole
                    if sum(map(len, media)) > 4 << 20:
                        yield full()
                copies += seq == 0
                if seq == len(got) - 1:
                    continue  # a repeated row of the same document
                if packed is None or seq != len(got):
                    raise ValueError(f"document {doc_id}: chunk {len(got)} is not in the store")
                piece = unpack(packed)
                if hashlib.sha256(piece).digest() != digest:
                    raise ValueError(f"document {doc_id}: chunk {seq} differs from its digest")
                got.append(piece)
        close()
        yield full()

    return placed.mapInArrow(run, schema)


def features(payload: bytes) -> str:
    """A coarse spectrum: share of samples in each of 16 equal level ranges (1/4096ths), mean level and mean step."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 4096 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) * 16 // len(x)
    return "".join(f"{v:04x}" for v in levels) + f"-{int(x.sum(dtype=np.int64)) * 16 // len(x):04x}-{step:04x}"


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's text as media, read it back and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Null texts count as empty ones (64 zero samples). Repeated rows give equal rows, as many as they
    are; a null id is kept. Other columns, whatever their names, are left out; an empty table gives no rows. Texts of any length: one media file is held at a time.
    """

    def make(part: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in part.column("media").to_pylist():
            n, payload = payload_of(media)
            out["n_bytes"].append(n)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(features(payload))
        return out | {"doc_id": part.column("doc_id")}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(read_back(*store(df, id_col, text_col)), make, schema)
