import random
from collections import Counter

import numpy as np

import corpus_pipeline
from quantloom.llm import shingle_sets


def test_pipeline_stages(spark, documents, empty, labels, tmp_path):
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert not {104, 105} & kept and len([r for r in kept if r == 7]) <= 1
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicates_are_those_of_brute_force_jaccard(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 4, 6, 9):
            copy = list(words)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = "edited"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "one two"), (901, "One  two"), (902, "")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    docs = spark.createDataFrame([(*row, "en", "s", len(row[1])) for row in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {rows[i][0] for i in set(up)} and len(got) < len(rows) - 30


def test_repeats_are_counted_in_words(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    own = lambda n: [word() + str(r.random())[2:] for _ in range(n)]
    passages = [[word() for _ in range(n)] for n in (50, 51, 55, 70)]
    rows = [own(20) + p + own(20) for p in passages for _ in range(2)] + [own(60)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = Counter(tuple(w[i : i + 51]) for w in rows for i in range(len(w) - 50))
    got = {x.doc_id: x.text.split() for x in corpus_pipeline.repeats(spark, docs, "").collect()}
    for i, w in enumerate(rows):
        gone = {k for j in range(len(w) - 50) if seen[tuple(w[j : j + 51])] > 1 for k in range(j, j + 51)}
        assert got[i] == [x for k, x in enumerate(w) if k not in gone]
    assert len(got[0]) == 90 and len(got[2]) == 40


def test_clashing_columns_and_repeated_ids(spark, documents, labels, tmp_path):
    """Extra columns of any name pass the stages unchanged; one id with several texts stays several documents."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    extra = documents.selectExpr("*", "'a' as predicted", "true as held_out", "5 as kept_text", "'b' as __key", "7 as row", "8 as component_id", "9 as lead").limit(20).where("text is not null")
    twice = spark.createDataFrame([(5000, f"{w} " * 30 + w + " end of it", "en", "s", 0) for w in ("alpha beta", "gamma delta", "epsilon zeta")], "doc_id long, text string, lang string, source string, n_chars long")
    docs = extra.unionByName(twice, allowMissingColumns=True)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert all(r.predicted in ("a", None) and r.kept_text in (5, None) and r["row"] in (7, None) for r in out.collect()), name
    got = [r.text for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).where("doc_id = 5000").collect()]
    assert len(got) == 3


def test_large_bands_are_compared_in_parts(spark, monkeypatch):
    """Bands over the size of a part give the same groups as whole ones."""
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in r.sample(range(len(words)), r.randint(0, 8)):
            words[at] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted((x.doc_id, x.component_id) for x in shingle_sets.similar_texts(docs).collect())
    monkeypatch.setattr(shingle_sets, "PART_BYTES", 8000)
    parts = sorted((x.doc_id, x.component_id) for x in shingle_sets.similar_texts(docs).collect())
    sets = [shingle_sets.shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if shingle_sets.jaccard(sets[i], sets[j]) >= 0.8 and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert whole == parts == list(enumerate(up)) and len(set(up)) > 3


def test_lines_over_the_ratio_go_and_others_stay(spark):
    r = random.Random(3)
    rows = [(i, "\n".join([" menu ", f"own line {i}", *(["shared"] if i % 9 == 0 else []), ""] if i % 2 else [f"own line {i}", "other"]), "en", f"s{i % 2}", 1) for i in range(120)]
    rows.append((500, None, "en", None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x for x in corpus_pipeline.lines(spark, docs, "").collect()}
    pages, seen = Counter(x[3] or "" for x in rows), Counter()
    for x in rows:
        for line in {y.strip() for y in (x[1] or "").split("\n")} - {""}:
            seen[x[3] or "", line] += 1
    for x in rows:
        kept = [y for y in (x[1] or "").split("\n") if not (y.strip() and seen[x[3] or "", y.strip()] >= 5 and seen[x[3] or "", y.strip()] > 0.1 * pages[x[3] or ""])]
        assert (got[x[0]].text or "") == "\n".join(kept) and got[x[0]].n_chars == len("\n".join(kept))
    assert r and got[1].text == "own line 1\n" and got[500].text is None


def test_quality_keeps_what_the_vote_accepts(spark, documents, labels, tmp_path):
    from quantloom.llm import knn_quality

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = knn_quality.train(documents, labels)
    want = sorted((x.doc_id, x.predicted) for x in knn_quality.score(documents, model).where("doc_id is not null").collect())
    got = sorted(x.doc_id for x in corpus_pipeline.quality(spark, documents, str(tmp_path)).where("doc_id is not null").collect())
    assert got == [i for i, p in want if p == 1]


def test_all_ids_are_packed(spark, documents):
    rows = corpus_pipeline.pack(spark, documents, "").collect()
    held = Counter()
    for x in rows:
        held[x.sequence_id] += x.length
    assert max(held.values()) <= 1024 and sum(x.length for x in rows) == sum(x.doc_tokens for x in rows if x.start == 0)


def test_near_duplicates_are_chosen_by_simhash(spark, monkeypatch):
    """Sets of similarity 0.8 lie within the reach, unlike ones beyond; the vantage points find close fingerprints; and
    without a reach nothing is linked."""
    r = np.random.default_rng(6)
    bits = lambda a, b: int(np.bitwise_count((shingle_sets.fingerprint(a) ^ shingle_sets.fingerprint(b)).view(np.uint64)).sum())
    for n in (5, 10, 40, 300, 5000):
        for _ in range(40):
            h = r.permutation(np.unique(r.integers(0, 1 << 63, 2 * n + 4, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 2 * n + 4).astype(np.uint64)))
            k = n // 5
            at = int(r.integers(0, k + 1))
            assert bits(np.append(h[: n - k], h[n - k : n - k + at]), np.append(h[: n - k], h[n - k + at : n])) <= shingle_sets.REACH
            assert n < 40 or bits(h[:n], h[n : 2 * n]) > shingle_sets.REACH
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:-1])), (2, " ".join(words[:1500])), (3, ""), (4, "one two")], "doc_id long, text string")
    sets = shingle_sets._points(docs, "doc_id", "text")
    of = {x.fp: x.doc_id for x in sets.collect()}
    assert [{of[x.a], of[x.b]} for x in shingle_sets._close(sets).collect()] == [{0, 1}]
    group = lambda: [x.component_id for x in sorted(shingle_sets.similar_texts(docs).collect(), key=lambda x: x.doc_id)]
    assert group() == [0, 0, 2, 3, 4]
    monkeypatch.setattr(shingle_sets, "REACH", -1)
    assert group() == [0, 1, 2, 3, 4]
