"""The Merkle manifest against a plain construction and against SQL, with trees of several bands."""

import hashlib
import zlib

import duckdb
import pytest

from quantloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i & ~1 : (i & ~1) + 2]
        out.append((run[0] if i & 1 else "", run[1] if not i & 1 and len(run) > 1 else ""))
        i >>= 1
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in groups[k]])
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            steps = path(trees[k], i) + path(top, j)
            d = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                d = leaf((*r[:3], r[3] + 1, r[4]))
            for a, b in steps:
                d = h(a, d, b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*[x for s in steps for x in s]), d, d == top[-1][0]))
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("band", [1, 2, 8])
def test_manifest(documents, band):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()]
    assert result(merkle.manifest(documents, band)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [257, 1, 2], [1030, 700, 4, 3, 2, 1, 65], [3] * 300])
def test_manifest_of_uneven_trees(spark, sizes):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((at * 7919 % 10_007, f"s{at % 3}", None if k == 0 else f"lang{'é' * (k % 2)}{k}", None if at % 11 == 0 else 2**63 - 1 if at == 2 else at, "" if at % 5 == 0 else f"text {at}"))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(merkle.manifest(df)) == sorted(plain(rows), key=repr)


def test_repeated_rows_nulls_and_empty_table(spark, empty):
    rows = [(1, None, "en", None, None)] * 5 + [(None, None, None, None, None)] * 3 + [(7, "", "", 0, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int")
    got = result(merkle.manifest(df, 2))
    assert got == sorted(plain(rows), key=repr) and {r[0]: r[6] for r in got}[1] is True
    assert merkle.manifest(empty).count() == 0 and merkle.manifest(empty).columns[-1] == "verified"


def test_manifest_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.SQL})").fetchall()
    got = result(merkle.manifest(spark.read.parquet(f"{folder}/documents.parquet")))
    assert got == sorted(want, key=repr) and 0 < sum(not r[6] for r in got) < len(got) / 4
