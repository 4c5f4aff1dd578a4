"""Operator 11: phrase collocation mining by Rabin-Karp fingerprints.

1. Prefix polynomials over the codes of the words give every run of words a fingerprint. Tasks sum fingerprints before the
   shuffle, which adds them up and keeps a pointer to an occurrence of each, a hash of its document.
2. A phrase is frequent only if its parts are, so single words are counted first, then pairs of frequent words, then runs
   of three to five whose pairs are all frequent. What is known to be frequent goes to the tasks as a sieve of bounded size,
   which never drops a frequent fingerprint; what it lets pass besides is sorted out by the counts.
3. Only where a pointer of a frequent fingerprint leads is a phrase made as text.
4. Collisions: every occurrence of a frequent fingerprint is held against the phrase at its pointer, by a second code of its
   text. Those that differ leave their task as text, are counted as the phrases they are, and are taken off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stage
from quantloom.llm.word_hash import LOWER, Sieve, mixed, run_codes, sieve_of, summed, text_bytes, text_slices, word_codes, word_places

#: Words of a phrase at most, its occurrences at least, phrases of a language, and the percentage of a phrase's
#: occurrences that a longer one must have to replace it.
WORDS, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Groups of a language's phrases that are ranked on their own first.
GROUPS = 32
#: Joins the hash of a document to a fingerprint; a product with 31 bits stays in a long.
_SPREAD = 1481765933


class Task(NamedTuple):
    """What a task holds before it sums up, and before it sends on; bits of a fingerprint (fewer ones collide)."""

    pending: int = 1 << 22
    held: int = 1 << 21
    bits: int = 64


_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False


class Words:
    """The words of a slice: places, codes that hold the language too, and whether each goes on with the next one."""

    def __init__(self, part: pa.RecordBatch, bits: int = 64) -> None:
        self.raw, self.cut = text_bytes(part.column("text"))
        self.start, self.end = word_places(self.raw, self.cut, _WORD)
        langs = part.column("lang").to_pylist()
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        self.doc = np.repeat(np.arange(part.num_rows), np.diff(np.searchsorted(self.start, self.cut)))
        self.lang = np.array([number[x] for x in langs], np.int64)[self.doc]
        self.at = part.column("at").to_numpy().astype(np.uint64)[self.doc]
        self.seed = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs], np.uint64)
        self.shift = np.uint64(64 - bits)
        self.codes = self._codes(0)
        n = len(self.start)
        self.joined = np.zeros(n, bool)
        if n > 1:
            parted = np.logical_or.reduceat(_BREAK[self.raw], self.start)
            self.joined[:-1] = ~parted[:-1] & (self.doc[1:] == self.doc[:-1])

    def _codes(self, base: int) -> np.ndarray:
        return mixed(word_codes(self.raw, self.start, self.end, base) ^ self.seed[self.lang]) if len(self.start) else np.zeros(0, np.uint64)

    def prints(self, size: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of ``size`` words at these places."""
        if not len(at):
            return np.zeros(0, np.uint64)
        return (self.codes if size == 1 else run_codes(self.codes, size))[at] >> self.shift

    def singles(self) -> tuple[int, np.ndarray, np.ndarray]:
        at = np.arange(len(self.codes))
        return 1, at, self.prints(1, at)

    def pairs(self, frequent: Sieve) -> tuple[int, np.ndarray, np.ndarray]:
        """(2, place, fingerprint) of the pairs of frequent words."""
        known = frequent.has(self.codes >> self.shift)
        at = np.flatnonzero(self.joined[:-1] & known[:-1] & known[1:]) if len(known) else np.zeros(0, np.int64)
        return 2, at, self.prints(2, at)

    def longer(self, words: Sieve, pairs: Sieve, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, place, fingerprint) of the runs of three words and more whose pairs are all frequent."""
        _, at, codes = self.pairs(words)
        good = np.zeros(len(self.codes) + most, bool)
        good[at[pairs.has(codes)]] = True
        whole = good[: len(self.codes)].copy()
        for size in range(3, most + 1):
            whole &= good[size - 2 : size - 2 + len(self.codes)]
            at = np.flatnonzero(whole)
            yield size, at, self.prints(size, at)

    def frequent(self, single: Sieve, pairs: Sieve, longer: Sieve, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, place, fingerprint, second code) of all runs whose fingerprints may be frequent."""
        checks = self._codes(1)
        for size, at, codes in (self.singles(), self.pairs(single), *self.longer(single, pairs, most)):
            known = (single, pairs, longer)[min(size, 3) - 1].has(codes)
            at, codes = at[known], codes[known]
            yield size, at, codes, (checks if size == 1 else run_codes(checks, size))[at] if len(at) else codes

    def text(self, data: bytes, size: int, i: int) -> bytes:
        """The run of ``size`` words at place ``i``, joined by single spaces; ``data``: the slice in lower case."""
        return b" ".join([data[a:b] for a, b in zip(self.start[i : i + size].tolist(), self.end[i : i + size].tolist(), strict=True)])

    def where(self, size: int, i: int) -> tuple[int, int, int]:
        """Row, and bytes of its text from and to, of the run at place ``i``."""
        d = int(self.doc[i])
        return d, int(self.start[i] - self.cut[d]), int(self.end[i + size - 1] - self.cut[d])


def _pointed(codes: Column, at: Column) -> Column:
    return codes.bitwiseXOR(at.cast("long") * F.lit(_SPREAD).cast("long"))


def _counted(docs: DataFrame, runs: Callable[[Words], list[tuple[int, np.ndarray, np.ndarray]]], task: Task, totals: bool = False) -> DataFrame:
    """(hash, n, at, lang): occurrences of each fingerprint and a document that has it, summed within the tasks; with
    ``totals`` the words of each language too, in rows without hash."""
    names = ["hash", "n", "at", "lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending, by_lang = 0, {}

        def sums() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return summed(*(list(x) for x in zip(*held, strict=True)))

        def send(h: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(h), 1 << 17):
                part = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(n[part]), pa.array(at[part]), pa.nulls(len(h[part]), pa.string())], names)

        for part in text_slices(batches):
            words = Words(part, task.bits)
            if totals:
                for k, n in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                    by_lang[words.langs[k]] = by_lang.get(words.langs[k], 0) + n
            for _, at, h in runs(words):
                held.append((h, np.ones(len(h), np.int64), words.at[at].astype(np.int32)))
                pending += len(h)
            if pending > task.pending:
                held = [sums()]
                pending = len(held[0][0])
                if pending > task.held:
                    yield from send(*held[0])
                    held, pending = [], 0
        if held:
            yield from send(*sums())
        if by_lang:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(by_lang), pa.int64()), pa.array(list(by_lang.values()), pa.int64()), pa.nulls(len(by_lang), pa.int32()), pa.array(list(by_lang))], names)

    counted = docs.select("text", "lang", "at").mapInArrow(run, "hash long, n long, at int, lang string")
    return counted.groupBy("hash", "lang").agg(F.sum("n").alias("n"), F.min("at").alias("at"))


_PLACE = "pointer struct<doc_id: long, start: long, end: long>"


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), schema, strict=True)], [name for name, _ in schema])


_POINTER = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _materialised(docs: DataFrame, sieves: Callable[[], tuple[Sieve, Sieve, Sieve]], pointers: Callable[[], Sieve], most: int, task: Task) -> DataFrame:
    """(level, hash, at, code, lang, phrase, pointer): the phrase of each frequent fingerprint in the document that it points
    to. Levels are single words, pairs, and longer runs, which were counted apart."""
    schema = [("level", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("code", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("pointer", _POINTER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pointed = sieves(), pointers()
        for part in text_slices(batches):
            words, rows = Words(part, task.bits), []
            data, ids = LOWER[words.raw].tobytes(), part.column("doc_id").to_pylist()
            for size, at, codes, checks in words.frequent(*known, most):
                ends = codes ^ (words.at[at] * np.uint64(_SPREAD))
                here = np.flatnonzero(pointed.has(ends))
                here = here[np.unique(ends[here], return_index=True)[1]]
                for k in here.tolist():
                    i = int(at[k])
                    d, a, b = words.where(size, i)
                    place = {"doc_id": ids[d], "start": a, "end": b}
                    rows.append((min(size, 3), int(codes[k].view(np.int64)), int(words.at[i]), int(checks[k].view(np.int64)), words.langs[words.lang[i]], words.text(data, size, i).decode("utf-8", "replace"), place))
            if rows:
                yield _batch(rows, schema)

    return docs.mapInArrow(run, f"level int, hash long, at int, code long, lang string, phrase string, {_PLACE}")


def _collisions(docs: DataFrame, sieves: Callable[[], tuple[Sieve, Sieve, Sieve]], verified: Callable[[], Sieve], most: int, task: Task) -> DataFrame:
    """(level, hash, lang, phrase, n, pointer): occurrences of frequent fingerprints whose text is not that of the phrase found for
    them, as text, summed within the tasks."""
    schema = [("level", pa.int32()), ("hash", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("pointer", _POINTER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, same = sieves(), verified()
        for part in text_slices(batches):
            words, found = Words(part, task.bits), {}
            data, ids = LOWER[words.raw].tobytes(), part.column("doc_id").to_pylist()
            for size, at, codes, checks in words.frequent(*known, most):
                for k in np.flatnonzero(~same.has(codes ^ checks)).tolist():
                    i = int(at[k])
                    key = (min(size, 3), int(codes[k].view(np.int64)), words.langs[words.lang[i]], words.text(data, size, i))
                    if key not in found:
                        d, a, b = words.where(size, i)
                        found[key] = [0, {"doc_id": ids[d], "start": a, "end": b}]
                    found[key][0] += 1
            if found:
                yield _batch([(level, h, lang, text.decode("utf-8", "replace"), *v) for (level, h, lang, text), v in found.items()], schema)

    return docs.mapInArrow(run, f"level int, hash long, lang string, phrase string, n long, {_PLACE}")


def frequent_phrases(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = WORDS, least: int = LEAST, task: Task = Task()
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, n and a pointer to an occurrence (doc_id and bytes of its text) of each phrase of up
    to ``most`` words that occurs ``least`` times or more in its language; lang and the number of its words."""
    spark = df.sparkSession
    text, doc_id = F.coalesce(df[text_col], F.lit("")), df[id_col].cast("long")
    at = F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    docs = df.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), at.alias("at"))

    def sieve(found: DataFrame, column: Column) -> Callable[[], Sieve]:
        shared = spark.sparkContext.broadcast(sieve_of(found.select(column.alias("h")), "h", found.count()).bits)
        return lambda: Sieve(shared.value)

    often = F.col("n") >= least
    seen = stage(_counted(docs, lambda w: [w.singles()], task, totals=True).where(often | F.col("hash").isNull()), "words")
    totals, one = seen.where("hash is null").select("lang", F.col("n").alias("n_lang")), seen.where("hash is not null")
    single = sieve(one, F.col("hash"))
    two = stage(_counted(docs, lambda w: [w.pairs(single())], task).where(often), "word-pairs")
    pairs = sieve(two, F.col("hash"))
    more = stage(_counted(docs, lambda w: list(w.longer(single(), pairs(), most)), task).where(often), "word-runs")
    longer = sieve(more, F.col("hash"))
    known = lambda: (single(), pairs(), longer())

    found = one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2))).unionByName(more.withColumn("level", F.lit(3))).drop("lang")
    pointers = sieve(found, _pointed(F.col("hash"), F.col("at")))
    texts = _materialised(docs, known, pointers, most, task).join(found, ["level", "hash", "at"])
    texts = texts.groupBy("level", "hash").agg(F.min(F.struct("lang", "phrase", "code", "pointer", "n")).alias("t")).select("level", "hash", "t.*")
    texts = stage(texts, "phrase-texts")
    verified = sieve(texts, F.col("hash").bitwiseXOR(F.col("code")))
    others = stage(_collisions(docs, known, verified, most, task).join(texts.select("level", "hash"), ["level", "hash"], "left_semi"), "phrase-collisions")
    off = others.groupBy("level", "hash").agg(F.sum("n").alias("off"))
    counted = texts.join(off, ["level", "hash"], "left").select("lang", "phrase", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"), "pointer")
    counted = counted.unionByName(others.select("lang", "phrase", "n", "pointer")).groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
    return stage(counted.where(often), "phrases"), totals


def collocations(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE, task: Task = Task()
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, and a pointer to an occurrence.

    Letters A-Z are lower-cased. Texts are split at . , ; : ! ? and line ends into pieces, and those at blanks and tabs into
    words. n counts the words of a language, a the occurrences of a phrase within pieces, overlaps included. A phrase of 2 to
    ``most`` words with a >= ``least`` is a candidate; cut after its first k words it has l and r occurrences of both parts
    and the score floor(1000 a n / (l r)). The lowest-scoring cut counts, of equal ones the first. A candidate that lies
    within a longer one with at least ``share`` per cent of its occurrences is dropped. Order: score and a falling, phrase
    rising, bytewise, so that no ties are left. Products are decimals of 38 digits.

    Null texts are empty ones, languages that are null are `und`. Repeated rows count as often as they stand there, null
    ids as any other. Other columns are not read. An empty table, or one without frequent phrases, gives no rows. A slice
    of texts is some 4 MB, or one longer text.
    """
    phrases, totals = frequent_phrases(df, id_col, text_col, lang_col, most, least, task)
    counts = phrases.select("lang", "phrase", "n")
    words = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    words = words.select("lang", "phrase", F.col("n").alias("a"), "words", F.size("words").alias("size"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = words.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals.select("lang", F.col("n_lang").alias("n")), "lang")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("cut"))

    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice("words", i, s), " ")))
    )
    covered = words.where("size > 2").select("lang", F.col("a").alias("b"), F.explode(F.array_distinct(inner)).alias("phrase"))
    covered = covered.groupBy("lang", "phrase").agg(F.max("b").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("cut.a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "cut.*").withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.join(phrases.select("lang", "phrase", "pointer"), ["lang", "phrase"])
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "pointer")


#: The same result for DuckDB, by counting every run of words.
SQL = """
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
runs AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, range(1, 6) AS t(s) WHERE len(w) >= s)),
f AS (SELECT lang, s, phrase, count(*) AS n FROM runs GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, s, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1 AND n >= 100),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (l.n::HUGEINT * r.n) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, s)) AS k FROM cand) c JOIN f l ON l.lang = c.lang AND l.s = c.k AND l.phrase = array_to_string(c.w[: c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.s = c.s - c.k AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, unnest(range(1, s - m + 2)) AS i FROM cand, range(2, 5) AS t(m) WHERE m < s)),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.longer IS NULL OR 100 * c.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
