"""Taggers, language and top-k against direct computation and held-out rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import langid, topk, toxicity
from folioframe.llm.base import fold

SF = "/root/testdata/sf0.01"


def test_marginals_equal_forward_backward():
    random = np.random.default_rng(0)
    chain = toxicity.Chain(np.array([[0, -1.0], [0.5, 0.3]]), -0.7, np.zeros(0, np.uint64), np.zeros(0), np.zeros(3))
    emission, starts = random.normal(size=5000), random.random(5000) < 0.01
    starts[0] = True
    got = chain.marginals(emission, starts)
    t = np.exp(chain.transitions)
    borders = np.append(np.flatnonzero(starts), 5000)
    for a, b in zip(borders, borders[1:]):
        e = np.exp(emission[a:b])
        forward, backward = np.zeros((b - a, 2)), np.ones((b - a, 2))
        forward[0] = [1, np.exp(chain.first) * e[0]]
        for i in range(1, b - a):
            forward[i] = (forward[i - 1] @ t) * [1, e[i]]
            forward[i] /= forward[i].sum()
        for i in range(b - a - 2, -1, -1):
            backward[i] = t @ (np.array([1, e[i + 1]]) * backward[i + 1])
            backward[i] /= backward[i].sum()
        both = forward * backward
        assert np.allclose(got[a:b], both[:, 1] / both.sum(axis=1))


def test_features_of_words():
    """Equal words, beginnings and endings have equal features, different ones different."""
    words = ["a", "abcde", "abcdefg", "xbcdefg", "défg", "abc", "é" * 60_000, "abcdefghij"]
    found = toxicity.features(words)
    keys: dict = {}
    for word, row in zip(words, found.tolist()):
        parts = [("=", word), *(("^", word[:n]) if len(word) > n else None for n in (3, 4, 5, 6)), *(("$", word[-n:]) if len(word) > n else None for n in (3, 4))]
        for part, value in zip(parts, row):
            assert (value == toxicity.NOTHING) == (part is None)
            assert part is None or keys.setdefault(part, value) == value
    assert len(set(keys.values())) == len(keys)


def test_gradient_is_zero_at_the_optimum():
    """The chain learns a word that is toxic only where it was labelled."""
    texts = ["fine day here", "what a vile day", "vile vile words", "nothing here", "some other words here"] * 40
    toxic = np.array([("vile" in t) for t in texts])
    chain = toxicity.fit([f"{t} {i}" for i, t in enumerate(texts)], toxic, 0.4)
    scores, spans = toxicity.Scorer(chain).score(pa.array(["A VILE thing", "a fine thing", "", None]))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5
    assert spans[1:] == [[]] * 3 and spans[0][0][0] <= 2 and spans[0][0][1] == 6


def test_only_similar_documents_are_copies():
    random = np.random.default_rng(3)
    passage = random.integers(0, 1000, 60).tolist()
    sharing = [[*random.integers(1000, 10**6, 40).tolist(), *passage] for _ in range(300)]
    assert len(set(toxicity.copy_groups(sharing).tolist())) == 300
    chain = [list(range(at, at + 100)) for at in range(0, 600, 30)]  # neighbours have 66 of 126 runs in common
    assert len(set(toxicity.copy_groups(chain).tolist())) == 20
    near = [[*doc[:50], 7, *doc[51:]] for doc in sharing]
    assert toxicity.copy_groups([*sharing, *near, [], [1, 2]]).tolist() == [*range(300), *range(300), 600, 601]


def test_copies_by_rarest_runs_are_all_copies():
    random = np.random.default_rng(4)
    docs = []
    for _ in range(60):
        base = random.integers(0, 50, random.integers(5, 80)).tolist()
        docs += [base[:len(base) - random.integers(0, 12)] for _ in range(4)]
    sets = [{tuple(d[i:i + 5]) for i in range(len(d) - 4)} for d in docs]
    want = []
    for i, own in enumerate(sets):
        like = [j for j in range(i) if own and want[j] == j and 10 * len(own & sets[j]) >= 8 * len(own | sets[j])]
        want.append(like[0] if like else i)
    assert toxicity.copy_groups(docs).tolist() == want


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    found = toxicity.score_toxicity(docs, chain).join(labels, "doc_id").where(fold("doc_id", 5) == 0)
    rows = found.select("predicted", "toxic", "spans", "score").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.95
    assert all(r.spans for r in rows if r.predicted and r.score > 0.9)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "bad"), (1, "bad"), (2, None), (None, ""), (4, "word " * 200_000)], "doc_id long, text string")
    assert toxicity.train(docs, labels.limit(0), F.lit(True)) is None
    none = toxicity.score_toxicity(docs, None).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)} and len(none) == 5
    chain = toxicity.train(docs, labels, F.lit(True))
    some = toxicity.score_toxicity(docs, chain).collect()
    assert len(some) == 5 and all(0 <= r.score <= 1 for r in some)
    assert toxicity.score_toxicity(docs.limit(0), chain).count() == 0
    assert toxicity.drop_toxic(docs, None).count() == 5


def test_offsets_survive_letters_that_grow():
    assert len(toxicity.folded("İstanbul ẞ İ")) == len("İstanbul ẞ İ")


def test_pooled_answers_equal_a_plain_convolution():
    random = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b"], 16, {w: random.normal(size=(w, 256, 2)).astype(np.float32) for w in (2, 3, 4)},
                         random.normal(size=6).astype(np.float32), random.normal(size=(6, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = random.integers(0, 256, (5, 16), dtype=np.uint8)
    want = []
    for w, f in net.filters.items():
        want.append(np.max([sum(f[k][x[:, p + k]] for k in range(w)) for p in range(16 - w + 1)], axis=0))
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(want, axis=1) + net.bias, 0), atol=1e-5)


def test_all_windows_count():
    random = np.random.default_rng(4)
    net = langid.ByteNet(["a", "b"], 8, {2: random.normal(size=(2, 256, 3)).astype(np.float32)}, np.zeros(3, np.float32),
                         random.normal(size=(3, 2)).astype(np.float32), np.zeros(2, np.float32))
    text = bytes(random.integers(65, 90, 21, dtype=np.uint8))
    parts = [net.document_scores([text[k:k + 8]])[0] * len(text[k:k + 8]) for k in (0, 8, 16)]
    assert np.allclose(net.document_scores([text])[0], sum(parts) / 21)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs, fold("doc_id", 4) != 2)
    rows = langid.predict(docs, net).join(docs, "doc_id").where((fold("doc_id", 4) == 2) & F.col("lang").isNotNull()).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    edges = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "the and of with"), (4, "é" * 300_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.predict(edges, net).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert found[None].lang_pred in net.languages and 0 < found[4].score <= 1
    assert {r.lang_pred for r in langid.predict(edges, None).collect()} == {"und"}
    assert langid.train(docs.limit(0), F.lit(True)) is None


@pytest.mark.parametrize("seed,n,k,block", [(1, 300, 5, 4096), (2, 500, 20, 64), (3, 12, 20, 4096)])
def test_top_k(spark, seed, n, k, block):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, 16))
    data = [(int(i), (centres[i % 6] + random.normal(size=16) * (0.02 if i % 2 else 0.6)).astype(float).tolist()) for i in range(n)]
    data += [(int(n), data[0][1]), (int(n + 1), [0.0] * 16), (int(n + 2), None), (int(n + 3), [1.0, None]), (int(n + 4), [float("nan")] * 16),
             (int(n + 5), [float("inf")] * 16), (int(n + 6), [2.0, -1.0]), (int(n + 7), [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, k=k, scale=64, block=block).collect()
    width = 16
    used = [(i, np.floor(64 * np.array(v + [0.0] * (width - len(v)))).astype(int)) for i, v in data
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in used:
        if q % 10 == 0:
            best = sorted((-int(a @ b), i) for i, b in used if i != q)[:k]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_index_stops_on_proof_only():
    random = np.random.default_rng(8)
    vectors = np.floor(64 * np.repeat(random.normal(size=(20, 32)), 50, axis=0) / 6 + random.normal(size=(1000, 32))).astype(np.int64)
    queries = vectors[::50]
    index = topk.ImpactIndex(vectors)
    found = index.search(queries, 10, np.zeros((1000, 20), dtype=bool))
    assert max(len(rows) for rows, _ in found) < 1000  # most vectors were ruled out
    for (rows, scores), q in zip(found, queries):
        exact = vectors @ q
        assert (scores == exact[rows]).all()
        assert sorted(scores)[::-1][:10] == sorted(exact)[::-1][:10]


def test_top_k_repeated_rows_and_nothing(spark):
    table = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(table, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 4096)] * 2 + [(2, 1, 4096)] * 2 + [(3, None, 4096)] * 2
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0
