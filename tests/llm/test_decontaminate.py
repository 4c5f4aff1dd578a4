"""Winnowed decontamination against a search for every window, and against SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from quantloom.llm import decontaminate, word_hash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, ids = set(), set()
        for item, text in items:
            k = words_of(text)
            n = min(size, len(k))
            windows = {tuple(k[j : j + n]) for j in range(len(k) - n + 1)} if k else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    ids.add(item)
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def made(seed, vocabulary):
    r = random.Random(seed)
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, phrase(n)) for k, n in enumerate([12, 10, 9, 5, 3, 1, 40, 25, 11, 10])] + [(20, None), (21, ""), (22, "!? -"), (None, phrase(14)), (6, phrase(12)), (30, "Straße ÉTÉ 日本 A1b2 c3 d4 e5 f6 g7 h8 i9")]
    docs = []
    for i in range(40):
        parts = [phrase(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            k = words_of(r.choice(items)[1])
            a = r.randint(0, max(0, len(k) - 1))
            parts += [r.choice([" ", ", ", "\n"]).join(k[a : a + r.randint(1, 30)]).upper(), phrase(r.randint(0, 4))]
        docs.append((i, "; ".join(parts)))
    return docs + [(100, None), (101, ""), (102, " .\x00\t"), (None, items[0][1]), (5, docs[5][1]), (6, docs[5][1]), (103, "x" * 5000 + " " + items[6][1] * 3), (104, items[-1][1].translate(LOWER))], items


@pytest.mark.parametrize("seed", range(3))
def test_against_every_window(spark, seed):
    vocabulary = ["a", "b", "cc", "the", "of", "und", "é", "7", "zz9"][: 3 + 3 * seed] if seed < 2 else [f"w{i}" for i in range(300)]
    docs, items = made(seed, vocabulary)
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, key string, n_hit int").repartition(3)
    b = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, length double")
    assert result(decontaminate.contaminated(d, b)) == plain(docs, items)


def test_empty_tables_and_spans(spark, empty):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "solo")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y solo"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(d, b).collect()}
    assert [tuple(s) for s in got[1].hit_spans] == [(1, 11), (12, 13)] and got[1].n_items == 2 and got[2].hit_spans == []
    assert decontaminate.contaminated(empty, b).count() == 0
    assert [r.n_hit for r in decontaminate.contaminated(d, b.limit(0)).collect()] == [0, 0]


def test_windows_shared_by_all_items_are_one_class(spark):
    head = "the following is a question about one of many topics "
    items = [(i, head + f"topic{i} " * (1 + i % 2)) for i in range(60)]
    docs = [(i, head + (f"topic{i} topic{i}" if i % 3 else "")) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.contaminated(d, b)) == plain(docs, items)


@pytest.mark.parametrize("length", range(1, 13))
def test_every_shared_window_has_a_common_hash(length):
    r = np.random.default_rng(length)
    codes = r.integers(0, 4, 400).astype(np.uint64)
    other = r.integers(0, 4, 300).astype(np.uint64)
    doc = np.zeros(400, int)
    doc[150:] = 1
    place, kept = decontaminate.kept_runs(codes, doc, length)
    kept_at, gram = set(place.tolist()), decontaminate.gram_of(length)
    for i in range(400 - length + 1):
        inside = [p for p in range(i, i + length - gram + 1) if p in kept_at]
        if doc[i] == doc[i + length - 1]:
            assert inside
            alone = decontaminate.kept_runs(codes[i : i + length], np.zeros(length, int), length)
            assert alone[0].tolist()[0] + i in kept_at
    assert len(decontaminate.kept_runs(other[: length - 1], np.zeros(length - 1, int), length)[0]) == 0


def test_words_and_codes():
    import pyarrow as pa

    texts = ["One two", "", "three", "THREEé x", "tail"]
    data, cut = word_hash.text_bytes(pa.array(texts).slice(0, 5))
    start, end = word_hash.word_places(data, cut, decontaminate._WORD)
    words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert words == ["One", "two", "three", "THREEé", "x", "tail"]
    codes = word_hash.word_codes(data, start, end)
    assert codes[2] == word_hash.word_codes(np.frombuffer(b"xx Three", np.uint8), np.array([3]), np.array([8]))[0] and len(set(codes.tolist())) == 6
    assert word_hash.text_bytes(pa.array(texts).slice(2, 2))[1].tolist() == [0, 5, 14]
    assert (word_hash.run_codes(codes, 2)[3] == word_hash.run_codes(codes[3:5], 2)[0]) and len(word_hash.run_codes(codes, 7)) == 0


def test_sieve_keeps_all(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    sieve = word_hash.sieve_of(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", len(h))
    assert sieve.has(h.view(np.uint64)).all()
    assert sieve.has(np.random.default_rng(2).integers(0, 2**64, 20000, dtype=np.uint64)).mean() < 0.02


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontaminate.SQL})").fetchall()
    got = result(decontaminate.contaminated(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))))
    assert got == sorted(want, key=repr) and any(r[5] for r in got)
