"""Exact and near duplicates against direct computation."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import exact, neardup
from folioframe.llm.base import in_files, key_columns

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60), min_size=1, max_size=4), st.integers(1, 8))
def test_quotient_filters_merge_without_loss(parts, quotient_bits):
    bits = 64 - quotient_bits
    built = [exact.QuotientFilter.build(np.array(p, dtype=np.uint64), bits, 0, 1 << quotient_bits) for p in parts]
    moved = [exact.QuotientFilter.loads(f.dumps()) for f in built]
    merged = moved[0].merge(moved[1:])
    want = collections.Counter(x for p in parts for x in p)
    assert dict(zip(merged.prints().tolist(), merged.counts.tolist())) == dict(want)
    assert merged.repeated().tolist() == sorted(x for x, n in want.items() if n > 1)


TEXTS = [(1, "Same text"), (2, "same TEXT"), (9, "SAME text"), (3, "other"), (4, None), (5, ""), (5, ""), (6, "ÉCOLE"), (7, "école"), (None, "lone"),
         (None, "Lone"), (8, "x" * 300_000), (10, "X" * 300_000), (11, "ÉCOLE")]


@pytest.mark.parametrize("range_size", [1 << 19, 2])
def test_exact_groups(spark, range_size):
    rows = [(i, t, "a", 1, "b") for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, row int, body string").repartition(3)
    got = exact.exact_groups(docs, range_size=range_size).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((repr(i), max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)
    assert sorted((repr(r.id), r.keep_id, r.group_size, r.text_sha256) for r in got) == [tuple(w) for w in want]
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_groups_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).count() == 0 and exact.drop_exact(docs).count() == 0


def brute(rows, like):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, text in rows:
        w = words.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + like.words]) for k in range(len(w) - like.words + 1)} if len(w) >= like.words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and like.den * len(a & sets[j]) >= like.num * len(a | sets[j]):
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        ids[root(i)].append(name)
    least = {r: min((n for n in names if n is not None), default=None) for r, names in ids.items()}
    return sorted((repr(name), len(sets[i]), repr(least[root(i)])) for i, (name, _) in enumerate(rows))


def family(rand, size, length, changes):
    """Copies of a text with some words changed; many of them are similar to some copies and not to others."""
    base = [rand.choice("abcdefgh") * rand.randint(1, 9) + str(rand.randint(0, 99)) for _ in range(length)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rand.randint(0, changes)):
            copy[rand.randrange(length)] = str(rand.randint(0, 10**6))
        yield " ".join(copy)


def near_rows():
    rand = random.Random(5)
    texts = [t for size, length, changes in ((40, 40, 3), (30, 25, 2), (60, 120, 12), (25, 18, 2)) for t in family(rand, size, length, changes)]
    walk = " ".join(str(rand.randint(0, 999)) for _ in range(60)).split()
    for _ in range(30):  # a chain: neighbours are similar, the ends are not
        walk[rand.randrange(60)] = str(rand.randint(0, 10**6))
        texts.append(" ".join(walk))
    texts += ["One two", "one TWO", "one\ttwo\n", "two one", "", " \n", None, None, "a b c", "A b\vc", "é b c", "É b c"]
    texts += [" ".join(map(str, range(30_000)))] * 2 + [" ".join(map(str, range(29_000)))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (None, "null id alone here"), (500, "")]
    rand.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [512, 16])
def test_near_groups(spark, cell):
    rows = near_rows()
    like = neardup.Similarity(words=3, num=85, den=100, cell=cell)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, cls int, sketch string").repartition(4)
    got = neardup.near_groups(docs, like).collect()
    assert sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, like)
    if cell > 100:
        kept = neardup.drop_near(docs, like)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.kept_row for r in got)


def test_cells_meet_every_pair_of_components(spark):
    """Asking and answering members: each pair of different components meets in a cell, cells stay near their bound."""
    like = neardup.Similarity(cell=8)
    members = spark.range(200).selectExpr("0 AS band", "id % 2 AS key", "id AS cls", "CASE WHEN id % 5 < 3 THEN -1 ELSE id % 7 END AS comp")
    cells = collections.defaultdict(lambda: ([], []))
    for r in neardup._cells(members, like).collect():
        cells[r.key, r.i, r.j][r.asks].append((r.cls, r.comp))
    met = {frozenset((a, b)) for answers, asks in cells.values() for a, c in asks for b, d in answers if c != d}
    comp = {i: -1 if i % 5 < 3 else i % 7 for i in range(200)}
    assert met == {frozenset((a, b)) for a in range(200) for b in range(a) if a % 2 == b % 2 and comp[a] != comp[b]}
    assert max(len(side) for pair in cells.values() for side in pair) < 40


def test_near_groups_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_groups(docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in neardup.near_groups(blank).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("size", range(2, 9))
def test_shingles_of_few_words(size):
    """Any number of words in all texts together, more or fewer than a shingle has."""
    like = neardup.Similarity(words=size)
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(words[:n]) for n in range(9)]
    assert [len(neardup.Shingler(like).sets(pa.array([t]))[0]) for t in texts] == [min(n, max(1, n - size + 1)) if n else 0 for n in range(9)]
    together = neardup.Shingler(like).sets(pa.array([None, *texts]))
    alone = [neardup.Shingler(like).sets(pa.array([t]))[0] for t in texts]
    assert [s.tolist() for s in together] == [[], *(s.tolist() for s in alone)]


def test_sketch_estimates_high_similarity():
    like = neardup.Similarity()
    tool = neardup.Shingler(like)
    random_ = np.random.default_rng(1)
    for share in (0.95, 0.85):
        common = random_.integers(0, 2**63, 2000, dtype=np.uint64)
        extra = round(2000 * (1 - share) / share / 2)
        a, b = (np.unique(np.concatenate([common, random_.integers(0, 2**63, extra, dtype=np.uint64)])) for _ in range(2))
        x, y = tool.sketches(np.stack([tool.signature(a), tool.signature(b)])).view(np.uint64)
        odd = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + like.bits / (4 * like.samples) * np.log(1 - 2 * odd / like.bits)
        assert abs(estimate - share) < 0.07 and odd <= like.most_bits


def test_rows_of_files_keep_their_names(spark, tmp_path):
    made = spark.range(100).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text", "1 AS x")
    made.repartition(5).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t")).where("doc_id < 90").select("doc_id", "text")
    assert in_files(docs) is docs
    names = [in_files(docs).select("doc_id", *key_columns()).repartition(n).collect() for n in (1, 3)]
    assert sorted(names[0]) == sorted(names[1]) and len({r[1:] for r in names[0]}) == 90
    grouped = docs.groupBy("text").count()
    assert in_files(grouped) is not grouped
    joined = docs.join(docs.select("text").distinct(), "text")
    assert in_files(joined) is not joined and in_files(joined).count() == 90


def test_no_link_of_the_documents_is_missed(spark):
    """Recall over all documents of the small tables: components and set sizes equal those of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    like = neardup.Similarity(words=3, num=85, den=100)
    got = neardup.near_groups(docs, like).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, like)
