"""Phrase mining against a count of every run of words, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quantloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=5, least=100, top=2000, share=100):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for s in range(1, most + 1):
                f.update((lang, tuple(w[i : i + s])) for i in range(len(w) - s + 1))
    found = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    longer = Counter()
    for (lang, w), n in found.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                longer[lang, w[i : i + s]] = max(longer[lang, w[i : i + s]], n)
    out = []
    for lang in total:
        mine = []
        for (x, w), a in found.items():
            if x == lang and not ((x, w) in longer and 100 * longer[x, w] >= share * a):
                score, k = min((1000 * a * total[x] // (f[x, w[:k]] * f[x, w[k:]]), k) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), f[x, w[:k]], f[x, w[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def made(seed, n=160):
    r = random.Random(seed)
    words = ["the", "of", "new", "york", "machine", "learning", "a", "İx", "straße", "NASA", "b-c", "d'e", "\x00", "日本"]
    fixed = ["new york city hall", "machine learning", "the state of the art", "to be or not to be"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 25)):
            parts.append(r.choice(fixed) if r.random() < 0.4 else r.choice(words))
            parts.append(r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ?", "\x0b", "\x85"]))
        text = "".join(parts)
        rows.append((i, text.upper() if i % 9 == 0 else text, r.choice(["en", "en", "de", None, ""])))
    return rows + [(500, None, "en"), (501, "", "fr"), (502, " \t.,", "fr"), (None, fixed[0] * 3, "en"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (503, "x " * 3000 + "x", "en"), (504, "y" * 40_000, "en")]


def result(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("seed, least, top, share", [(0, 20, 2000, 100), (1, 5, 7, 100), (2, 40, 2000, 60)])
def test_against_every_run(spark, seed, least, top, share):
    rows = made(seed)
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = phrases.collocations(df, least=least, top=top, share=share)
    assert result(got) == plain(rows, least=least, top=top, share=share)
    texts = {x[0]: (x[1] or "").encode() for x in rows}
    for r in got.collect():
        raw = texts[r.pointer.doc_id][r.pointer.start : r.pointer.end].decode().translate(LOWER)
        assert " ".join(re.findall("[^\x20\x09]+", raw)) == r.phrase


@pytest.mark.parametrize("task", [phrases.Task(50, 10), phrases.Task(bits=12), phrases.Task(bits=7)])
def test_small_buffers_and_colliding_fingerprints(spark, task):
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert result(phrases.collocations(df, least=15, task=task)) == plain(rows, least=15)


def test_fingerprints_follow_words_not_spaces():
    import pyarrow as pa

    part = lambda *t: pa.RecordBatch.from_arrays([pa.array(t), pa.array(["en"] * len(t)), pa.array([1] * len(t))], ["text", "lang", "at"])
    a, b = phrases.Words(part("One  two\tthree, four", "five six")), phrases.Words(part("x one two three"))
    assert a.prints(3, np.array([0])) == b.prints(3, np.array([1])) and a.joined.tolist() == [True, True, False, False, True, False]
    assert a.text(b"one  two\tthree, fourfive six", 3, 0) == b"one two three" and a.where(2, 4) == (1, 0, 8)


def test_products_beyond_64_bits(spark):
    a, n, x, y = 9 * 10**9 + 7, 10**13 + 1, 10**10 + 9, 9 * 10**9 + 11
    got = spark.sql(f"SELECT CAST(1000 AS DECIMAL(4,0)) * CAST({a} AS DECIMAL(19,0)) * CAST({n} AS DECIMAL(15,0)) div (CAST({x} AS DECIMAL(19,0)) * CAST({y} AS DECIMAL(19,0))) AS v").first().v
    assert got == 1000 * a * n // (x * y)


def test_empty(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "rare words", "en")], "doc_id long, text string, lang string")).columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.SQL})").fetchall()
    got = result(phrases.collocations(spark.read.parquet(f"{folder}/documents.parquet")))
    assert got == sorted(want) and got
