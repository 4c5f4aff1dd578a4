"""Each operator against brute force or an exact round trip, on tables that hold what may go wrong."""

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quantloom.llm import (
    common,
    context_tree,
    cutting_stock,
    knn_quality,
    language_model,
    licences,
    long_repeats,
    media_chunks,
    neighbours,
    packing,
    piece_codec,
    run_index,
    simhash,
    site_lines,
    vantage,
)

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 45), (60, 60), (None, 1)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 45: 40, 50: 40, 60: 60}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stage_two_tables_a_round(spark, monkeypatch):
    """Every staged table costs executors files; labels are staged for several rounds at once."""
    from quantloom.llm import common

    names, plain = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: names.append(name) or plain(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(x) for x in common.components(edges).collect()} == {(i, 0) for i in range(41)}
    rounds = names.count("jumps")
    assert rounds > 1 and names.count("links") == rounds + 1 and names.count("labels") == -(-rounds // common.JUMPS) and len(names) == 2 * rounds + 1 + names.count("labels")


@pytest.mark.parametrize("order", ["rising", "falling", "zigzag"])
def test_components_of_long_chains(spark, order):
    n = 10_000
    names = {"rising": range(n), "falling": range(n - 1, -1, -1), "zigzag": [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]}[order]
    edges = list(zip(names, names[1:])) + [(n + 5, n + 1)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: n, n + 1: 2}


def test_media_round_trip(documents, texts_by_row, empty):
    got = by_id(media_chunks.media_features(documents).collect())
    assert sum(map(len, got.values())) == len(texts_by_row)
    for i, text in texts_by_row:
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[3][0].feature == got[104][0].feature and got[3][0].media_sha256 == got[105][0].media_sha256
    assert media_chunks.media_features(empty).count() == 0


def test_chunks_are_shared_and_cuts_follow_content():
    data = bytes(np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8))
    a, b = media_chunks.cuts(data), media_chunks.cuts(b"some bytes before" + data)
    assert a[-1] == len(data) and all(x < y <= x + media_chunks.MOST for x, y in zip([0, *a], a))
    assert len({x + 17 for x in a} & set(b)) > 0.8 * len(a)
    assert media_chunks.cuts(b"") == []


def test_missing_chunk_raises(documents):
    lists, kept, words = media_chunks.store(documents.where("doc_id < 5"))
    gone = kept.limit(1).select("digest").first()[0]
    with pytest.raises(Exception, match="not in the store"):
        media_chunks.read_back(lists, kept.where(kept.digest != gone), words).count()


def test_quality(documents, labels, empty, texts_by_row):
    model = knn_quality.train(documents, labels)
    got = by_id(knn_quality.score(documents, model).collect())
    assert sum(map(len, got.values())) == len(texts_by_row)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for v in got.values() for r in v)
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, v in got.items() for r in v)
    assert got[3][0].score == got[104][0].score and got[100][0].score == got[101][0].score
    assert knn_quality.score(empty, model).count() == 0
    assert knn_quality.score(documents, knn_quality.train(documents, labels.where("doc_id < 0"))).first().score == 0.5


def test_vote_is_exact():
    rng = np.random.default_rng(0)
    known, y, q = rng.normal(size=(200, 8)).astype(np.float32), rng.integers(0, 2, 200).astype(np.float32), rng.normal(size=(9, 8)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    got = knn_quality.vote({"known": known, "labels": y}, q)
    for v, g in zip(q, got):
        c = known @ (v / np.linalg.norm(v))
        top = np.argsort(-c)[: knn_quality.NEIGHBOURS]
        w = np.maximum(c[top], 0).astype(float) ** knn_quality.SHARPNESS + 1e-9
        assert abs((w * y[top]).sum() / w.sum() - g) < 1e-5


def test_site_lines(spark, documents, empty):
    pages = [(i, f"http://Big.example:80/p{i}", f"<p>shared foot</p><p>own {i}</p><script>x<y</script>") for i in range(12)]
    pages += [(20, "http://small.example/", "<p>shared foot</p>"), (21, None, "<p>shared foot</p>"), (22, "nonsense", None)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, lines int")
    got = {r.page_id: r for r in site_lines.dedup_html(df).collect()}
    assert all(got[i].kept_text == f"own {i}" and got[i].n_dropped == 1 and got[i].host == "big.example" for i in range(12))
    assert got[20].kept_text == "shared foot" and got[21].host == "" and got[22].n_lines == 0
    assert len(got) == len(pages) and site_lines.dedup_html(df.limit(0)).count() == 0
    spread = site_lines.drop_boilerplate(df.select("page_id", site_lines.host_of(df.url).alias("host"), site_lines.html_lines(df.html).alias("lines")), broadcast_bytes=-1)
    assert {r.page_id: r.n_dropped for r in spread.collect()} == {i: r.n_dropped for i, r in got.items()}
    assert site_lines.dedup_texts(documents).count() == documents.count() and site_lines.dedup_texts(empty).columns == empty.columns


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(documents, texts_by_row, empty):
    got = by_id(simhash.near_duplicates(documents).collect())
    prints = [fingerprint(t) for _, t in texts_by_row]
    up = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            if (a ^ b).bit_count() <= 2:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    for k, (i, _) in enumerate(texts_by_row):
        group = [texts_by_row[j][0] for j in range(len(up)) if up[j] == up[k] and texts_by_row[j][0] is not None]
        assert all(r.fingerprint == f"{prints[k]:016x}" or len(got[i]) > 1 for r in got[i])
        assert got[i][0].component_id == min(group, default=None)
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    hot = np.full(6000, base[5])
    for _ in range(3):
        hot = hot ^ (np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, hot]))
    pairs = [np.nonzero(np.bitwise_count(points[i : i + 256, None] ^ points[None]) <= 2) for i in range(0, len(points), 256)]
    a, b = np.concatenate([p[0] + 256 * i for i, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs])
    want = vantage.Union(len(points))
    want.link(a, b)
    assert (vantage.link_close(points) == want.roots(np.arange(len(points)))).all()
    tree, n = vantage.fit(points, 9, 2)
    at, shard = vantage.route(tree, points, 2)
    where = [set() for _ in points]
    for x, s in zip(at, shard):
        where[x].add(int(s))
    assert n == 9 and all(where[x] & where[y] for x, y in zip(a[:200_000], b[:200_000]))


def test_dense_ball_by_midpoints(spark):
    rng = np.random.default_rng(4)
    x = np.full(300, 77, np.uint64)
    for _ in range(4):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    x = np.unique(x)
    links = simhash._midpoint_links(spark.createDataFrame([(0, int(v)) for v in x.view(np.int64)], "shard int, fp long"))
    got = {r.node: r.component for r in common.components(links).collect()}
    roots = vantage.link_close(x)
    for i, r in enumerate(roots):
        same = [int(v) for v in x[roots == r].view(np.int64)]
        assert got.get(int(x[i : i + 1].view(np.int64)[0]), same[0]) == min(same)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 12)).astype(np.float32) * rng.uniform(0.5, 2, (1200, 1)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] * 12, 1), (2060, [1.0] * 3, 1), (None, x[0].tolist(), 1), (5, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df).collect()
    best = {}
    for r in got:
        best.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 1200, 20):
        s = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(1200), -np.round(s, 9))) if i != q][:20]
        assert sorted(best[q]) == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-9 for i, v in best[q].values())
        hits += len({i for i, _ in best[q].values()} & set(order))
    assert hits >= 0.9 * 20 * 60 and set(best) == set(range(0, 1200, 20))
    few = neighbours.nearest(df.where("vec_id < 4")).collect()
    assert [(r["rank"], r.vec_id) for r in few if r.query_id == 0].__len__() == 3
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(30)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 20").orderBy("rank").collect()
    order = sorted((i for i in range(30) if i != 20), key=lambda i: (-((1 + i * 1e-12) * (1 + 20 * 1e-12) + 1), i))
    assert [r.vec_id for r in got] == order[:20]


def test_graph_recall_where_the_beam_is_a_small_part():
    from quantloom.llm import pruned_graph

    rng = np.random.default_rng(4)
    x = (rng.standard_normal((40, 48))[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 48))).astype(np.float32)
    y = pruned_graph.lifted(x, float(np.linalg.norm(x.astype(float), axis=1).max()))
    graph, start = pruned_graph.build(y)
    ids, _ = pruned_graph.beam_search(y, graph, start, np.pad(x[:200], ((0, 0), (0, 1))), 100)
    best = np.argsort(-(x[:200].astype(float) @ x.T.astype(float)), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(best.tolist(), ids.tolist())]) > 0.95 * 21


def test_piece_codec(documents, texts_by_row, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piece_codec.encode_decode(documents, PIECES).collect())
    for i, text in texts_by_row:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want for r in got[i])
    assert piece_codec.encode_decode(empty, PIECES).count() == 0
    codec = piece_codec.load(PIECES)
    assert codec.agenda("▁internationalisation" * 4) == codec._ids([library.id_to_piece(i) for i in codec.agenda("▁internationalisation" * 4)])
    assert codec._heap("▁straightforward") == codec.agenda("▁straightforward")


def test_packing(documents, texts_by_row, empty):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(documents, BYTES).collect()
    ids = [(i, [*library.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts_by_row]
    total = Counter()
    for i, x in ids:
        total[i] += len(x)
    held = Counter()
    for r in rows:
        held[r.doc_id] += r.length
        match = [x for i, x in ids if i == r.doc_id and len(x) == r.doc_tokens]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in match)
    assert held == total
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert packing.pack(empty, BYTES).count() == 0


def test_ids_are_the_librarys():
    import random

    r, library = random.Random(2), Tokenizer.from_file(BYTES)
    alphabet = [chr(i) for i in range(256)] + list("  \n'sll1.<|endoftext|>") + ["<|endoftext|>"]
    spaces = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "'s", "'", "a", "Zé", "1", "٣", "!", "。", "\u200b", "\U0001f600"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(r.choice(spaces) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    texts += ["日本 é", "", " ", "  ", "a ", " a", "a  b", "a\n b", "a <|endoftext|> b", ""]
    got = packing.load(BYTES).ids(texts)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert np.frombuffer(got[-2], "<u4").tolist() == [64, 220, 50256, 275]


def test_marks_at_the_ends_of_words_are_not_new_words(monkeypatch):
    """A word with marks after it needs no encoding where the word and the marks are known."""
    ids = packing.TextIds(BYTES)
    ids.ids(["a word", "a other. other!?"])
    encoded, plain = [], ids._encoded
    monkeypatch.setattr(ids, "_encoded", lambda texts: encoded.extend(texts) or plain(texts))
    texts = ["a word. word!? other", "a don't.", "a dogs' x'", "a é. 日. 1. '."]
    assert ids.ids(texts[:1]) == plain(texts[:1]) and not any("word" in t for t in encoded)
    assert ids.ids(texts) == plain(texts)


def test_each_different_word_is_encoded_once(monkeypatch):
    """Also where line feeds join the words, and in whichever order; ages and slices change nothing."""
    ids = packing.TextIds(BYTES)
    encoded, plain = [], ids._encoded
    monkeypatch.setattr(ids, "_encoded", lambda texts: encoded.extend(texts) or plain(texts))
    texts = ["start one two.\nthree four\ntwo one", "start four\nthree two one\nthree, two", "start\nthree", "", "start", "start ", "\nfive", "start\n\nthree", "start \nthree", "start\n three", "start\r\nthree", "é\n日 本"]
    assert ids.ids(texts) == plain(texts)
    words = [x for x in encoded if x.lstrip(" \n") in ("one", "two", "three", "four")]
    assert sorted(words) == sorted({" one", " two", "\nthree", " four", "\ntwo", " three"})
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    assert [ids.ids([t]) for t in texts] == [plain([t]) for t in texts] and ids.ids([]) == []


MIXES = {
    "240-262": lambda r: r.integers(240, 263, 20_000), "mean 120": lambda r: np.clip(r.exponential(120, 20_000).astype(int), 1, 1023), "1-255": lambda r: r.integers(1, 256, 20_000), "200-511": lambda r: r.integers(200, 512, 20_000),
    "1-1024": lambda r: r.integers(1, 1025, 20_000), "500-520": lambda r: r.integers(500, 521, 20_000), "2-29": lambda r: r.integers(2, 30, 20_000), "330-350": lambda r: r.integers(330, 351, 20_000), "900-1023": lambda r: np.append(r.integers(900, 1024, 9000), r.integers(1, 130, 9000)),
}


@pytest.mark.parametrize("mix", MIXES)
def test_real_padding(mix):
    """Sequences of real lengths against what any plan needs: the ids over 1,024, and one for each piece of over half."""
    lengths = MIXES[mix](np.random.default_rng(0))
    edges = np.array(cutting_stock.class_edges(Counter(lengths.tolist())))
    kinds = edges[np.searchsorted(edges, lengths)]
    pools = {int(k): lengths[kinds == k].tolist() for k in edges}
    made = cutting_stock.plan({k: len(v) for k, v in pools.items()}, 1024)
    used = [sum(pools[k].pop() for k, n in pattern.items() for _ in range(n)) for pattern, times in made for _ in range(times)]
    assert not any(pools.values()) and max(used) <= 1024
    need = max(lengths.sum() / 1024, (lengths > 512).sum())
    assert sum(cutting_stock.fill_cost(u, 1024) for u in used) <= 1.03 * 1024 * need


def brute_classes(histogram, classes):
    lengths = sorted(histogram)
    cost = lambda edges: sum(n * (next(e for e in edges if e >= k) - k) for k, n in histogram.items())
    return min(cost((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], classes - 1))


def test_classes_round_up_the_least():
    rng = np.random.default_rng(3)
    for classes in (1, 2, 3, 5):
        h = {int(k): int(v) for k, v in zip(rng.choice(60, 9, replace=False) + 1, rng.integers(1, 50, 9))}
        edges = cutting_stock.class_edges(h, classes)
        assert len(edges) <= classes and sum(n * (min(e for e in edges if e >= k) - k) for k, n in h.items()) == brute_classes(h, classes)
    assert cutting_stock.class_edges({}) == [] and cutting_stock.class_edges({5: 1, 9: 2, 7: 0}) == [5, 9]


def test_cutting_stock():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 129, 20_000), return_counts=True))}
    made = cutting_stock.plan(histogram, 128)
    held = Counter()
    for pattern, times in made:
        assert sum(k * n for k, n in pattern.items()) <= 128
        for k, n in pattern.items():
            held[k] += n * times
    assert held == histogram
    assert sum(k * v for k, v in histogram.items()) / (128 * sum(t for _, t in made)) > 0.99
    assert cutting_stock.plan({}, 128) == []


def test_licences(spark, empty):
    texts = ["x y\nReleased under the MIT License.\nz", "released UNDER the mit licence", None, "", "a " * 5000, licences.TEMPLATES[1][1].replace("See", "\nSee"), "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, dice double")).collect()}
    assert [got[i].licence for i in range(7)] == ["MIT", None, None, None, None, "Apache-2.0", "CC-BY-NC-4.0"]
    assert got[6].n_matches == 2 and got[0].dice == 1.0
    scanner = licences.Scanner()
    for unit in texts[:2] + [t for _, t in licences.TEMPLATES] + ["Released under a MIT License"]:
        a = licences.bigrams(unit or "")
        want = max(((2 * len(a & s) / (len(a) + len(s)), -i) for i, s in enumerate(scanner.sets)))
        best = scanner.best(unit)
        assert (best is None and want[0] < 0.8) or (best == (want[0], -want[1]))
    assert licences.scan_licences(empty).count() == 0


def test_language_model(documents, texts_by_row, empty):
    got = by_id(language_model.score(documents).collect())
    train = Counter()
    for i, t in texts_by_row:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*language_model.words_of(t), b""])
    n, v = sum(train.values()), len(train)
    for i, t in texts_by_row:
        words = [*language_model.words_of(t), b""]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert any(r.n_tokens == len(words) and r.n_known == sum(train[w] > 0 for w in words) and r.train_tokens == n and abs(r.base_score - base) < 1e-6 * max(1, abs(base)) for r in got[i])
        assert all(r.score < 0 and math.isfinite(r.score) for r in got[i])
    assert language_model.score(empty).count() == 0


def test_licences_inside_lines_and_over_blocks():
    scanner = licences.Scanner()
    names = lambda t: [scanner.names[f[2]] for f in scanner.scan(t)]
    bsd3 = next(t for n, t in licences.TEMPLATES if n == "BSD-3-Clause")
    bsd2 = next(t for n, t in licences.TEMPLATES if n == "BSD-2-Clause")
    blocks = "Copyright 2020 Foo Inc. All rights reserved.\n\n" + bsd3.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").replace("the copyright holder nor", "Foo Inc nor")
    assert names(blocks) == ["proprietary", "BSD-3-Clause"]
    assert names("some words " + bsd2 + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS") == ["BSD-2-Clause"]
    assert names("Copyright 2020 Foo Inc. All rights reserved.") == ["proprietary"]
    assert names("Licensed under the Apache License, Version 2.0. See LICENSE for details.") == ["Apache-2.0"]
    assert names("As said, this work is licensed under the GNU General Public License, version 3. Thus it may be shared.") == ["GPL-3.0"]


def test_many_matches_in_one_text():
    import time

    scanner = licences.Scanner()
    notice = "Released under the MIT License.\n"
    began = time.perf_counter()
    found = scanner.scan("Some words. " + notice * 8000)
    assert [scanner.names[f[2]] for f in found] == ["MIT"] * 8000 and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert time.perf_counter() - began < 30


def test_whole_licence_texts():
    scanner = licences.Scanner()
    names = lambda t: [scanner.names[f[2]] for f in scanner.scan(t)]
    whole = {n: max((t for m, t in licences.TEMPLATES if m == n), key=len) for n in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Zlib")}
    for n, t in whole.items():
        assert names("Some words before.\n\n" + t.replace(". ", ".\n") + "\nand some after") == [n], n


def test_licence_windows_against_brute_force():
    """A text holds a template if any of its runs of words reaches the threshold."""
    import random

    r = random.Random(11)
    picked = [(n, t) for n, t in licences.TEMPLATES if len(t) < 330]
    for trial in range(60):
        name, t = r.choice(picked)
        words = licences._WORD.findall(t.lower())
        for _ in range(r.randint(0, max(1, len(words) // 4))):
            words[r.randrange(len(words))] = r.choice(["alpha", "beta", "the", "of"])
        noise = lambda: [r.choice(["the", "of", "license", "software", "x", "y"]) for _ in range(r.randint(0, 8))]
        text = " ".join(noise() + words + noise()).split()
        own = licences.bigrams(t)
        dice = lambda w: 2 * len((b := licences.bigrams(" ".join(w))) & own) / (len(b) + len(own))
        best = max(dice(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1))
        found = licences.Scanner(((name, t),)).scan(" ".join(text))
        assert bool(found) == (best >= 0.8) and (not found or len(found) > 1 or found[0][3] <= best + 1e-12), (trial, name, best)


def plain_tree_bits(learnt, context, byte, depth=5, least=3):
    """Context-tree weighting by its definition: the ratio of the root's weighted probability with and without the bit."""
    counts = {}
    for s in learnt:
        s = b" " * depth + s
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts.setdefault(s[i - d : i], Counter())[s[i]] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def at(c, k):
        node, zeros, ones = byte >> (k + 1), 0, 0
        for x, n in counts.get(c, {}).items():
            if x >> (k + 1) == node:
                zeros, ones = (zeros, ones + n) if x >> k & 1 else (zeros + n, ones)
        return zeros, ones

    def weighted(c, k, new):
        here = new if context.endswith(c) else (0, 0)
        a, b = (x + y for x, y in zip(at(c, k), here))
        kids = [] if len(c) == depth else [x for x in (bytes([y]) + c for y in range(256)) if sum(counts.get(x, Counter()).values()) >= least and sum(at(x, k))]
        if not kids:
            return kt(a, b)
        on_path = any(context.endswith(x) for x in kids)
        held = [sum(at(x, k)[i] for x in kids) + (here[i] if on_path else 0) for i in (0, 1)]
        under = sum(weighted(x, k, new) for x in kids) + kt(a - held[0], b - held[1])
        return math.log(0.5) + np.logaddexp(kt(a, b), under)

    return -sum(weighted(b"", k, (0, 1) if byte >> k & 1 else (1, 0)) - weighted(b"", k, (0, 0)) for k in range(8)) / math.log(2)


def test_language_model_is_plain_context_tree_weighting(spark):
    rows = [(i, t) for i, t in enumerate(["abab ab", "abba abab", "ab", "baab", "b a b ab", "abab abab aba", "abaz"])]
    learnt = [language_model.stream_of(language_model.words_of(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in (rows[0], rows[4], rows[6]):
        s = b" " * 5 + language_model.stream_of(language_model.words_of(t))
        want = sum(plain_tree_bits(learnt, s[j - 5 : j], s[j]) for j in range(5, len(s)))
        assert abs(got[i].score + want * math.log10(2)) < 1e-6 * want


def whole_tree(streams):
    """The tree of all byte contexts, in one place, without a bound by share."""
    rows = Counter()
    for s in streams:
        s = b" " * 5 + s
        rows.update((d, int.from_bytes(s[i - d : i], "big"), s[i]) for i in range(5, len(s)) for d in range(6))
    often = Counter()
    for (d, c, _), n in rows.items():
        often[d, c] += n
    a = np.array([(d, c, b, n) for (d, c, b), n in rows.items() if d == 0 or often[d, c] >= 3])
    return context_tree.ContextTree(a[:, 0], a[:, 1].astype(np.uint64), a[:, 2], a[:, 3])


def tree_score(tree, stream):
    s = b" " * 5 + stream
    c = np.array([int.from_bytes(s[i - 5 : i], "big") for i in range(5, len(s))], np.uint64)
    return tree.log2(c, np.full(len(stream), 5), np.frombuffer(stream, np.uint8)).sum() * math.log10(2)


def test_language_model_keeps_every_context(documents, texts_by_row, spark, monkeypatch):
    rows = [*texts_by_row, *((1000 + i, "common text " * 6000) for i in range(9)), *((2000 + i, "quixotry zyx") for i in range(4))]
    learnt = [language_model.stream_of(language_model.words_of(t)) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tree = whole_tree(learnt)
    monkeypatch.setattr(language_model, "HEAD_GRAMS", 200)
    got = by_id(language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for i, t in rows:
        want = tree_score(tree, language_model.stream_of(language_model.words_of(t)))
        assert any(abs(r.score - want) < 1e-4 * abs(want) for r in got[i])
    assert got[2000][0].bits_per_byte < 3  # four among 650,000 bytes


def test_language_model_reads_word_order(spark):
    fluent = "one two three four five six seven eight nine ten eleven twelve"
    mixed = "seven one ten four two twelve nine three eleven five eight six"
    rows = [*((i, fluent) for i in range(40)), (100, mixed)]
    got = by_id(language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[100][0].base_score == pytest.approx(got[0][0].base_score) and got[100][0].score < got[0][0].score - 3


def test_context_tree_is_a_distribution():
    words = [b"the", b"then", b"abba", b"ab", b"the"] * 5
    who, context, length, byte = context_tree.positions(words, 3)
    rows = Counter()
    for c, n, b in zip(context.tolist(), length.tolist(), byte.tolist()):
        for d in range(n + 1):
            rows[d, c & ((1 << 8 * d) - 1), b] += 1
    a = np.array([(d, c, b, n) for (d, c, b), n in rows.items()])
    tree = context_tree.ContextTree(a[:, 0], a[:, 1].astype(np.uint64), a[:, 2], a[:, 3], 3)
    for c, n in ((0x20, 1), (0x2074, 2), (0x7A7A7A, 3)):
        p = 2 ** tree.log2(np.full(256, c, np.uint64), np.full(256, n), np.arange(256).astype(np.uint8))
        assert abs(p.sum() - 1) < 1e-5
    assert tree.log2(np.array([0x2074], np.uint64), np.array([2]), np.array([ord("h")], np.uint8))[0] > -1
    x = np.array([0.5, 1, 3.7, 1000.5])
    assert np.allclose(context_tree._lgamma(x), [math.lgamma(v) for v in x])


def test_run_index():
    rng = np.random.default_rng(1)
    for trial in range(80):
        t = rng.integers(1, 4, int(rng.integers(1, 50)))
        t = np.append(np.concatenate([t, t]) if trial % 3 == 0 else t, 0)
        n, suffix = len(t), [tuple(t[i:]) for i in range(len(t))]
        order = sorted(range(n), key=suffix.__getitem__)
        assert run_index.suffix_array(t).tolist() == order
        match = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want = [max((match(suffix[i], suffix[j]) for j in range(n) if j != i), default=0) for i in range(n)]
        index = run_index.RunIndex(t)
        assert index.matching_statistics().tolist() == want and index.text().tolist() == t.tolist() and len(index.heads) <= n


def test_an_index_takes_little_memory():
    """Besides its text, at most 40 bytes a symbol: contexts that are half alike, and text that repeats itself."""
    import tracemalloc

    rng = np.random.default_rng(4)
    common = rng.integers(0, 256, 140, dtype=np.uint8).tobytes()
    for parts in ([common + rng.integers(0, 256, 135, dtype=np.uint8).tobytes() for _ in range(8000)], [b"ab" * 1_000_000]):
        tracemalloc.start()
        marks = long_repeats.mark_shard(parts, [1] * len(parts), 204)
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 40 * sum(map(len, parts)) + 16_000_000
        assert [len(x) for x, _ in marks] == ([0] * 8000 if len(parts) > 1 else [1])


def test_blocks_of_suffixes_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, 3, 500), 0), np.append(np.tile([1, 2], 300), 0), np.append(np.ones(400, int), 0)]
    whole = [run_index.RunIndex(t, 3) for t in texts]
    monkeypatch.setattr(run_index, "BLOCK", 7)
    for t, want in zip(texts, whole):
        assert run_index.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert run_index.RunIndex(t, 3).matching_statistics().tolist() == want.matching_statistics().tolist()


def test_text_that_repeats_itself_sends_each_anchor_once(spark, monkeypatch):
    """A pair of words a thousand times over has the same anchor and context at many places, which make one row each."""
    tables, plain = {}, long_repeats.stage
    monkeypatch.setattr(long_repeats, "stage", lambda df, name: tables.setdefault(name, plain(df, name)))
    rows = [(i, f"start{i} " + "ab cd " * 1000 + f"end{i}") for i in range(3)]
    got = by_id(long_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for (i, text), want in zip(rows, brute_repeats(rows, 400)):
        assert (got[i][0].n_bytes, got[i][0].n_removed, got[i][0].n_spans, got[i][0].kept_sha256) == (len(text), *want)
    assert tables["contexts"].count() < 100 and sum(len(r.hash) for r in tables["anchors"].collect()) < 100


def test_texts_longer_than_a_winnowing_block(spark):
    rng = np.random.default_rng(8)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = letters(900)
    long = letters((1 << 19) - 300) + shared + letters(700_000)
    rows = [(1, long), (2, "x" + shared[:600] + "y"), (None, shared[300:]), (3, long[: 1 << 19][-500:]), (3, long[: 1 << 19][-500:])]
    got = by_id(long_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r.n_removed, r.n_spans) for r in got[1]] == [(1100, 1)] and (got[2][0].n_removed, got[None][0].n_removed) == (600, 600) and [r.n_removed for r in got[3]] == [500, 500]


def brute_repeats(texts, length):
    data = [t.encode() for _, t in texts]
    seen = Counter(d[j : j + length] for d in data for j in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("most, left", [(8 << 20, 8 << 20), (2000, 8 << 20), (2000, 500), (0, 0)])
def test_long_repeats(documents, texts_by_row, empty, monkeypatch, most, left):
    monkeypatch.setattr(long_repeats, "ANCHOR_BYTES", most)
    monkeypatch.setattr(long_repeats, "PART_BYTES", left)
    got = by_id(long_repeats.remove_repeats(documents).collect())
    for (i, t), want in zip(texts_by_row, brute_repeats(texts_by_row, 400)):
        assert any((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t.encode()), *want) for r in got[i])
    assert got[110][0].n_removed >= 400 and got[5][0].n_removed == 0 and got[5][0].kept_text is None
    assert long_repeats.remove_repeats(empty).count() == 0
