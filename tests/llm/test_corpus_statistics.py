"""Spelling variants, token files and source divergence against direct computation."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import divergence, packing, spelling, tokenfile
from folioframe.llm.vocabularies import tokenizer_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
WORDS = tokenizer_path("word_bpe_49k.json")


# --- spelling -----------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_spelling(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w, ""), words.get(form.get(w), -1), root(w)) for w, n in words.items())


def spelling_rows():
    rand = random.Random(3)
    stems = ["".join(rand.choice("abcdeéß×") for _ in range(rand.randint(5, 8))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rand.randint(0, 40)):
            w = stems[min(int(rand.expovariate(0.3)), 24)]
            if rand.random() < 0.5:
                k = rand.randrange(len(w))
                w = rand.choice([w[:k] + w[k + 1:], w[:k] + rand.choice("abé") + w[k:], w[:k] + rand.choice("abé") + w[k + 1:]])
            words.append(w.upper() if rand.random() < 0.1 else w)
        rows.append((i, rand.choice([" ", ", ", "ā", "¿", "日"]).join(words)))
    long = "x" * 200
    return rows + [(None, "abcde abcde abcde Abcdé"), (7, None), (8, ""), (9, f"{long} {long} {long} {long}y " * 3), (9, f"{long} {long} {long} {long}y " * 3), (10, "É éÉé ééééé ÉÉÉÉÉ")]


@pytest.mark.parametrize("symbols", [None, 2, 9])
def test_spelling_groups(spark, symbols):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.spelling_groups(docs, symbols=symbols).collect()
    assert sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in got) == brute_spelling(rows)
    assert sum(r.form is not None for r in got) > 20


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert spelling.spelling_groups(docs).count() == spelling.spelling_groups(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=9), st.lists(st.binary(max_size=64), min_size=1, max_size=5))
def test_joined_checksums(prefix, words):
    sums = spelling.Checksums()
    got = sums.joined(np.full(len(words), zlib.crc32(prefix), dtype=np.uint32), np.array([zlib.crc32(w) for w in words], dtype=np.uint32), np.array([len(w) for w in words]))
    assert got.tolist() == [zlib.crc32(prefix + w) for w in words]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeé×ÿ"), min_size=1, max_size=7), min_size=2, max_size=12, unique=True), st.integers(2, 6))
def test_near_words_share_one_key(words, symbols):
    own, key, of = spelling.neighbourhood(pa.array(words), symbols)
    asks = collections.Counter(zip(of.tolist(), key.tolist()))
    assert max(asks.values(), default=1) == 1
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i < j and one_edit(a, b):
                assert (own[i] == own[j]) + ((i, int(own[j])) in asks) + ((j, int(own[i])) in asks) == 1


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:04d}", f"w{i + 1:04d}") for i in range(37)] + [(f"s{i}", "w0000") for i in range(50)]
    got = spelling.last_forms(spark.createDataFrame(chain, "word string, form string"))
    assert {(r.word, r.root) for r in got.collect()} == {(w, "w0037") for w, _ in chain}


# --- token files --------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([tokenfile.BYTES, tokenfile.BITS]))
def test_planes_round_trip(ids, planes):
    ids = np.array(ids, dtype="<u4")
    if len(ids):
        assert tokenfile.from_planes(tokenfile.to_planes(ids, planes), len(ids), planes).tolist() == ids.tolist()


@pytest.mark.parametrize("planes", [tokenfile.BYTES, tokenfile.BITS])
def test_file_round_trip(tmp_path, planes):
    random_ = np.random.default_rng(5)
    lengths = random_.integers(0, 90, 60)
    ids = random_.integers(0, 60_000, lengths.sum()).astype(np.uint32)
    path = f"file:{tmp_path}/sub/a.bin"
    out = tokenfile.Writer(path, tokenfile.Layout(block=64, planes=planes))
    ends = np.cumsum(lengths)
    names = [None, *range(59)]
    for a, b in ((0, 7), (7, 7), (7, 60)):
        out.append(names[a:b], ids[ends[a] - lengths[a]:ends[b - 1] if b else 0] if b > a else ids[:0], lengths[a:b])
    assert not (tmp_path / "sub" / "a.bin").exists()
    out.close()
    reader = tokenfile.Reader(path)
    assert [(n, at, c, np.concatenate([np.zeros(0, int), *p]).tolist()) for n, at, c, p in reader.each()] == [
        (n, int(e - c), int(c), ids[e - c:e].tolist()) for n, e, c in zip(names, ends, lengths)]
    for start, count in ((0, 1), (63, 2), (100, 700), (len(ids) - 3, 50), (5, 0)):
        assert reader.tokens(start, count).tolist() == ids[start:start + count].tolist()
    data = bytearray((tmp_path / "sub" / "a.bin").read_bytes())
    with pytest.raises(ValueError):
        (tmp_path / "cut.bin").write_bytes(data[:-1])
        tokenfile.Reader(str(tmp_path / "cut.bin"))
    data[int(reader.index["offset"][1]) + 12] ^= 255
    (tmp_path / "bad.bin").write_bytes(data)
    with pytest.raises((ValueError, tokenfile.zstandard.ZstdError)):
        tokenfile.Reader(str(tmp_path / "bad.bin")).chunk(1)


@pytest.mark.parametrize("layout", [tokenfile.Layout(), tokenfile.Layout(block=100, planes=tokenfile.BITS, file_ids=500, file_documents=7)])
def test_token_files(spark, layout):
    rand = random.Random(2)
    rows = [(i, " ".join(rand.choice(["some", "Words", "again.", "日本"]) for _ in range(rand.randint(0, 60)))) for i in rand.sample(range(10**6), 120)]
    rows += [(None, "null id"), (3, None), (4, ""), (2**60 + 1, "a"), (6, "w " * 100_000), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, path string, before int").repartition(3)
    got = tokenfile.read_token_files(tokenfile.write_token_files(docs, WORDS, layout=layout), with_ids=True).collect()
    tokenizer, _ = packing._tokenizer(WORDS)
    want = {}
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[at] = (i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids)
        at += len(ids)
    assert len(got) == len(rows) and {r.start: (r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in got} == want
    assert tokenfile.read_token_files(tokenfile.write_token_files(docs.limit(0), WORDS)).count() == 0


# --- divergence ---------------------------------------------------------------

def brute_divergence(rows, min_df=3, top=200):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= min_df]
        sources = {d[1] for d in own}
        count = {s: collections.Counter(t for _, x, ts in own if x == s for t in ts) for s in sources}
        whole = collections.Counter(t for _, _, ts in own for t in ts)
        v = len(kept)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v)

        table = {s: {t: p(count[s], t) for t in kept} for s in sources}
        base = {t: p(whole, t) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = sorted((-sum(f(table[s][t], table[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(table[s][t], base[t]), t.encode(), t) for t in kept if count[s][t] > 0 and table[s][t] > base[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows():
    rand = random.Random(8)
    vocabulary = ["".join(rand.choice("abcdeé日Z") for _ in range(rand.randint(1, 4))) for _ in range(300)]
    rows = []
    for _ in range(250):
        lang, source = rand.choice(["en", "en", "fr", None, "x"]), rand.choice(["a", "b", "c", "é", None, "ab"])
        rows.append((lang, source, rand.choice([" ", "1", "\n[", "\x7f"]).join(vocabulary[min(int(rand.expovariate(0.02)), 299)] for _ in range(rand.randint(0, 60)))))
    return rows + [("en", "bare", None), ("en", "bare", "12 [] @"), ("en", "", "word"), ("lone", "one", "a b"), ("lone", "two", None), ("solo", "s", "w w w"), rows[0], rows[0],
                   ("en", "big", "ab " * 50_000)]


@pytest.mark.parametrize("top,pairs", [(200, 10**6), (3, 7)])
def test_source_divergence(spark, monkeypatch, top, pairs):
    rows = divergence_rows()
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, rank int, item string").repartition(4)
    got = divergence.source_divergence(docs, top=top).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute_divergence(rows, top=top)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_probabilities_of_huge_counts(spark):
    n, total, kept = 7 * 10**13, 3 * 10**15, 10**9
    row = spark.range(1).select(divergence.probability(*(divergence.F.lit(x) for x in (n, total, kept))).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + kept)
