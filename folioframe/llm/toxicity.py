"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words. Token labels for training come from labelled documents: a
feature (a word, a beginning or an ending of words) that occurs in so many toxic
and so few clean documents that chance is ruled out marks its tokens in toxic
documents. The chain is trained on these labelled tokens; forward-backward gives
each token's marginal, marginals add up to a document score, and runs of tokens
above one half are the offending spans.

Both passes of forward-backward are prefix products of 2 × 2 matrices. They run
over all texts of a slice at once, in blocks side by side, where the first token
of a text forgets what came before.
"""

from __future__ import annotations

import logging
import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import WordValues, bounded_batches, byte_slices, few_by_hash, hash_order, slices, tidy

_LOG = logging.getLogger(__name__)
WORD = re.compile(r"\w+")
#: Features of a token: the word, four beginnings and two endings.
SLOTS = 7
#: The feature that a short word has instead of a beginning or ending; it never gets a weight.
NOTHING = 0
_WIDTH = 128
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "_")
#: The base of the hash of letters, odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def folded(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens_of(chunks: pa.Array) -> tuple[list[str], np.ndarray]:
    """Tokens of what stands between white spaces, behind one another, and the number of each chunk."""
    heads = pc.ascii_rtrim(chunks, characters=_PUNCTUATION)
    simple = pc.match_substring_regex(heads, "^[a-z0-9_]+$").to_pylist()
    found = [[h] if plain else WORD.findall(folded(c)) for h, plain, c in zip(heads.to_pylist(), simple, chunks.to_pylist())]
    return [w for ws in found for w in ws], np.fromiter(map(len, found), dtype=np.int64, count=len(found))


def features(words: list[str]) -> np.ndarray:
    """(words, SLOTS) 64-bit hashes of the features of lower-case words; ``NOTHING`` where a word is too short for one.

    Hashes of beginnings and endings are differences of running sums, so all
    features of many words are found together.
    """
    out = np.zeros((len(words), SLOTS), dtype=np.uint64)
    for at in range(0, len(words), 50_000):
        part = words[at:at + 50_000]
        letters = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        most = int(sizes.max(initial=0)) + 1
        powers, backs = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(most, f, dtype=np.uint64)]), dtype=np.uint64) for f in (_BASE, _UNBASE))
        worth = (letters + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(starts, sizes)]
        running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(worth, dtype=np.uint64)])
        sums = [running[ends] - running[starts]]
        for n in (3, 4, 5, 6):
            sums.append(running[np.minimum(starts + n, ends)] - running[starts])
        for n in (3, 4):
            cut = np.maximum(sizes - n, 0)
            sums.append((running[ends] - running[starts + cut]) * backs[cut])
        for k, (value, n) in enumerate(zip(sums, (0, 3, 4, 5, 6, 3, 4))):
            x = (value + np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & _MASK)) * np.uint64(0x9FB21C651E98DF25)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[at:at + len(part), k] = np.where(sizes > n, np.maximum(x ^ (x >> np.uint64(31)), np.uint64(1)), np.uint64(NOTHING))
    return out


def prefix_vectors(a, b, c, d, start: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """``start · M_0 · … · M_t`` for every t, each scaled to sum 1; M_t = [[a, b], [c, d]] at t."""
    n = len(a)
    if n <= _WIDTH:
        x, y = start
        first, second = np.empty(n), np.empty(n)
        for t, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
            x, y = x * p + y * r, x * q + y * s
            total = x + y
            x, y = x / total, y / total
            first[t], second[t] = x, y
        return first, second
    blocks = -(-n // _WIDTH)

    def columns(m, fill):
        out = np.full(blocks * _WIDTH, fill)
        out[:n] = m
        return np.ascontiguousarray(out.reshape(blocks, _WIDTH).T)

    a, b, c, d = columns(a, 1.0), columns(b, 0.0), columns(c, 0.0), columns(d, 1.0)
    for t in range(1, _WIDTH):
        pa_, pb, pc, pd_ = a[t - 1], b[t - 1], c[t - 1], d[t - 1]
        na, nb = pa_ * a[t] + pb * c[t], pa_ * b[t] + pb * d[t]
        nc, nd = pc * a[t] + pd_ * c[t], pc * b[t] + pd_ * d[t]
        scale = 1.0 / (na + nb + nc + nd)
        a[t], b[t], c[t], d[t] = na * scale, nb * scale, nc * scale, nd * scale
    x, y = prefix_vectors(a[-1], b[-1], c[-1], d[-1], start)
    x, y = np.concatenate([[start[0]], x[:-1]]), np.concatenate([[start[1]], y[:-1]])
    first, second = x * a + y * c, x * b + y * d
    total = first + second
    return (first / total).T.ravel()[:n], (second / total).T.ravel()[:n]


@dataclass
class Chain:
    """Transition weights (from, to), the weight of a toxic first token, features (ascending) with their weights, and the document model."""

    transitions: np.ndarray
    first: float
    hashes: np.ndarray
    weights: np.ndarray
    document: np.ndarray

    def emissions(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that each token of the chunks alone gives for toxic, and the number of tokens of each chunk."""
        words, counts = tokens_of(chunks)
        found = features(words)
        if not len(self.hashes):
            return np.zeros(len(words)), counts
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, self.weights[at], 0.0).sum(axis=1), counts

    def messages(self, emission: np.ndarray, starts: np.ndarray):
        """Forward and backward vectors of tokens; ``starts`` marks first tokens."""
        e = np.exp(np.clip(emission, -30, 30))
        t = np.exp(self.transitions)
        s = np.exp(self.first)
        a, b = np.where(starts, 1.0, t[0, 0]), np.where(starts, s, t[0, 1]) * e
        c, d = np.where(starts, 1.0, t[1, 0]), np.where(starts, s, t[1, 1]) * e
        forward = prefix_vectors(a, b, c, d, (0.5, 0.5))
        last = np.append(starts[1:], True)  # behind a last token, the message is 1
        after = [np.where(last, 1.0, np.append(m[1:], 1.0))[::-1] for m in (a, c, b, d)]
        backward = prefix_vectors(*after, (0.5, 0.5))
        return forward, (backward[0][::-1], backward[1][::-1]), e

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of each token to be toxic."""
        if not len(emission):
            return np.zeros(0)
        (f0, f1), (b0, b1), _ = self.messages(emission, starts)
        return f1 * b1 / (f0 * b0 + f1 * b1)

    def document_score(self, highest: np.ndarray, summed: np.ndarray) -> np.ndarray:
        x = document_features(highest, summed) @ self.document
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def document_features(highest: np.ndarray, summed: np.ndarray) -> np.ndarray:
    """Of a document's marginals: one, their maximum, and the logarithm of one plus their sum."""
    return np.stack([np.ones(len(highest)), highest, np.log1p(summed)], axis=1)


def per_document(marginals: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest marginal and their sum, per document; 0 without tokens."""
    highest, summed = np.zeros(len(counts)), np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        heads = (np.cumsum(counts) - counts)[full]
        highest[full], summed[full] = np.maximum.reduceat(marginals, heads), np.add.reduceat(marginals, heads)
    return highest, summed


def first_tokens(counts: np.ndarray) -> np.ndarray:
    starts = np.zeros(int(counts.sum()), dtype=bool)
    starts[(np.cumsum(counts) - counts)[counts > 0]] = True
    return starts


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit: the sample has at most this many toxic and clean documents of up to ``most_chars``."""

    toxic: int = 1500
    clean: int = 4000
    most_chars: int = 100_000
    window: int = 40
    windows: int = 3
    rounds: int = 50
    rate: float = 0.15
    ridge: float = 4.0
    seed: int = 11


def copy_groups(tokens: list[np.ndarray], size: int = 5, like: float = 0.8) -> np.ndarray:
    """A number for each document that its copies share: the first earlier document whose set of word runs is similar to its own.

    A document is compared with the first ones of groups only, and belongs to a
    group if the share of common runs in all runs of both is ``like`` or more.
    Sets so similar have a run in common among the rarest of each (as many as
    may be missing in the other, and one), so common passages cost no comparison
    and no similar pair is lost.
    """
    runs: list[np.ndarray] = []
    for words in tokens:
        w, n = np.asarray(words, dtype=np.uint64) + np.uint64(1), max(0, len(words) - size + 1)
        hashed = np.zeros(n, dtype=np.uint64)
        for k in range(size if n else 0):
            hashed = (hashed + w[k:n + k]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        runs.append(np.unique(hashed))
    groups = np.arange(len(tokens), dtype=np.int64)
    if not sum(map(len, runs)):
        return groups
    known, documents = np.unique(np.concatenate(runs), return_counts=True)
    firsts: dict[int, list[int]] = {}  # by each of their rarest runs
    for i, own in enumerate(runs):
        if not len(own):
            continue
        rarest = own[np.lexsort([own, documents[np.searchsorted(known, own)]])][:len(own) - math.ceil(like * len(own) - 1e-9) + 1].tolist()
        for j in sorted({j for run in rarest for j in firsts.get(run, ())}):
            other = runs[j]
            if min(len(own), len(other)) < like * max(len(own), len(other)) - 1e-9:
                continue
            common = len(np.intersect1d(own, other, assume_unique=True))
            if common >= like * (len(own) + len(other) - common) - 1e-9:
                groups[i] = j
                break
        else:
            for run in rarest:
                firsts.setdefault(run, []).append(i)
    return groups


def token_evidence(tokens: list[np.ndarray], toxic: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` features mark toxic tokens; ``tokens`` are the words of each document, ``table`` the features of each word.

    A feature's share of toxic documents must be 0.8 or more, and so far above
    the share in the sample that no feature of all those seen would be expected
    to reach it by chance (binomial tail bound).
    """
    hits, total = np.zeros(size), np.zeros(size)
    for words, bad in zip(tokens, toxic.tolist()):
        found = np.unique(table[np.unique(words)])
        total[found] += 1
        if bad:
            hits[found] += 1
    share, base = hits / np.maximum(total, 1), min(max(toxic.mean(), 1e-9), 1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0.0)
        bound = total * (share * np.log(np.maximum(share, 1e-12) / base) + rest)
    return (share >= 0.8) & (bound >= np.log(max(2, size)) + 4)


def fit(texts: list[str], toxic: np.ndarray, prior: float, settings: Training = Training()) -> Chain:
    """Trains chain and document model on labelled documents; ``prior`` is the share of toxic ones beyond the sample."""
    random = np.random.default_rng(settings.seed)
    number: dict[str, int] = {}  # of each token seen

    def numbers(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, sizes = tokens_of(chunks)
        return np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)), sizes

    lookup = WordValues(numbers, np.int32)
    tokens = []
    for begin, end in slices(texts):
        flat, counts = lookup.of(pa.array(texts[begin:end], pa.string()))
        tokens += np.split(flat, np.cumsum(counts)[:-1])
    # copies of a document would be taken for independent evidence
    seen: set[tuple[int, bool]] = set()
    keys = list(zip(copy_groups(tokens).tolist(), toxic.tolist()))
    single = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
    _LOG.info("toxicity sample without copies: %d of %d toxic and %d of %d clean documents",
              toxic[single].sum(), toxic.sum(), (~toxic[single]).sum(), (~toxic).sum())
    tokens, toxic = [tokens[i] for i in single], toxic[single]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    lookup.clear()
    hashes, table = np.unique(features(list(number)), return_inverse=True)
    table = table.astype(np.int32).reshape(-1, SLOTS)
    number.clear()
    all_tokens = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int32)
    chain = Chain(np.zeros((2, 2)), 0.0, hashes[:0], np.zeros(0), np.zeros(3))
    weights = np.zeros(len(hashes))
    both = 0 < toxic.sum() < len(toxic)
    if both and len(all_tokens):
        marks = token_evidence(tokens, toxic, table, len(hashes)) & (hashes != NOTHING)
        labels = marks[table].any(axis=1)[all_tokens] & np.repeat(toxic, counts)
        # windows of every clean document, and of toxic ones around labelled tokens
        begins = np.cumsum(counts) - counts
        rows, lengths = [], []
        for i, n in enumerate(counts.tolist()):
            hits = np.flatnonzero(labels[begins[i]:begins[i] + n]) if toxic[i] else None
            if not n or (toxic[i] and not len(hits)):
                continue  # a toxic document without a labelled token says nothing about its tokens
            centres = random.choice(hits, min(len(hits), settings.windows), replace=False) if toxic[i] else random.integers(0, n, settings.windows)
            for at in sorted({max(0, min(int(c) - settings.window // 2, n - settings.window)) for c in centres}):
                rows.append(np.arange(begins[i] + at, begins[i] + min(n, at + settings.window)))
                lengths.append(len(rows[-1]))
        if rows:
            places = np.concatenate(rows)
            weights = _train(chain, table[all_tokens[places]], labels[places], first_tokens(np.array(lengths)), hashes != NOTHING, settings)
    chain.hashes, chain.weights = hashes[weights != 0], weights[weights != 0]
    emission = weights[table].sum(axis=1) if len(table) else np.zeros(0)
    parts = [(np.zeros(0), np.zeros(0))]
    for begin, end in slices(tokens, 200_000):
        part = counts[begin:end]
        parts.append(per_document(chain.marginals(emission[np.concatenate(tokens[begin:end])], first_tokens(part)), part))
    highest, summed = (np.concatenate(p) for p in zip(*parts))
    share = toxic.mean()
    weight = np.where(toxic, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)) if both else np.ones(len(toxic))
    x, y = document_features(highest, summed), toxic.astype(float)
    for _ in range(60):  # Newton steps of a ridge regression
        p = 1 / (1 + np.exp(-np.clip(x @ chain.document, -50, 50)))
        slope = x.T @ (weight * (y - p)) - 0.01 * chain.document
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        chain.document = chain.document + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return chain


def _train(chain: Chain, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, weighed: np.ndarray, settings: Training) -> np.ndarray:
    """Adam on the conditional likelihood, observed minus expected counts; returns the feature weights."""
    seen = np.bincount(ids.ravel(), minlength=len(weighed)) > 0
    used = np.flatnonzero(seen)
    compact = (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    zero = np.flatnonzero(~weighed[used])
    y = labels.astype(float)
    inner = ~starts
    before = np.flatnonzero(inner) - 1
    observed = np.array([[((1 - y[before]) * (1 - y[before + 1])).sum(), ((1 - y[before]) * y[before + 1]).sum()],
                         [(y[before] * (1 - y[before + 1])).sum(), (y[before] * y[before + 1]).sum()]])
    values = np.zeros(len(used) + 5)
    m, v = np.zeros_like(values), np.zeros_like(values)
    for turn in range(1, settings.rounds + 1):
        chain.transitions, chain.first = values[-5:-1].reshape(2, 2), values[-1]
        (f0, f1), (b0, b1), e = chain.messages(sum(values[compact[:, k]] for k in range(SLOTS)), starts)
        p = f1 * b1 / (f0 * b0 + f1 * b1)
        t = np.exp(chain.transitions)
        pairs = np.stack([f0[before] * t[0, 0] * b0[before + 1], f0[before] * t[0, 1] * (e * b1)[before + 1],
                          f1[before] * t[1, 0] * b0[before + 1], f1[before] * t[1, 1] * (e * b1)[before + 1]])
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad = np.concatenate([
            sum(np.bincount(compact[:, k], y - p, minlength=len(used)) for k in range(SLOTS)) - settings.ridge * values[:-5],
            (observed - expected).ravel(), [(y - p)[starts].sum()]])
        grad[zero] = 0
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        values = values + settings.rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        values[-5] = 0.0
    chain.transitions, chain.first = values[-5:-1].reshape(2, 2), float(values[-1])
    weights = np.zeros(len(weighed))
    weights[used] = values[:-5]
    return weights


def train(docs: DataFrame, labels: DataFrame, learnable: Column, settings: Training = Training(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Chain | None:
    """The model learned from the labelled documents for whose labels ``learnable`` holds; None without any.

    Labels with a null id or value are left out; of several labels of a
    document the highest counts, of several texts the greatest. The sample takes
    the documents with the smallest hash of their id from each class, and is
    trained on in one task.
    """
    known = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).alias("bad"))
    totals = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    if not totals:
        return None
    prior = totals.get(True, 0) / sum(totals.values())
    by_hash = lambda bad, n: known.where((F.col("bad") == bad) & few_by_hash("id", n, F.lit(max(1, totals.get(bad, 0))))).orderBy(
        *hash_order("id")).limit(n)
    chosen = by_hash(True, settings.toxic).unionAll(by_hash(False, settings.clean))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        F.coalesce(F.length("text"), F.lit(0)) <= settings.most_chars).join(F.broadcast(chosen), "id").groupBy("id", "bad").agg(
        F.max("text").alias("text"))

    def run(batches):
        rows = sorted((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())), key=lambda r: r[0])
        if rows:
            texts, bad = [t or "" for *_, t in rows], np.array([bool(b) for _, b, _ in rows])
            rows.clear()
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(texts, bad, prior, settings))]}, schema=pa.schema([("model", pa.binary())]))

    out = sample.coalesce(1).mapInArrow(tidy(run), "model binary").collect()
    return pickle.loads(out[0]["model"]) if out else None


class Scorer:
    """Scores texts with a chain; remembers the emissions of words, up to a bound."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, WordValues(chain.emissions, np.float64, limit=400_000)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        emission, counts = self.known.of(texts)
        marginals = self.chain.marginals(emission, first_tokens(counts))
        highest, summed = per_document(marginals, counts)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        begins = np.cumsum(counts) - counts
        for i in np.flatnonzero(highest >= 0.5).tolist():
            bad = marginals[begins[i]:begins[i] + counts[i]] >= 0.5
            for k, (m, hit) in enumerate(zip(WORD.finditer(texts[i].as_py()), bad.tolist())):
                if hit and k and bad[k - 1]:
                    spans[i][-1] = (spans[i][-1][0], m.end())
                elif hit:
                    spans[i].append(m.span())
        return self.chain.document_score(highest, summed), spans


def score_toxicity(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` per document; spans are code points, end exclusive, of offending runs of words.

    Null and empty texts get the score of a text without tokens, and every text
    gets 0 if nothing was learned. Rows that repeat stay and score alike; texts
    are read whole.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for begin, end in byte_slices(batch.column(1), 2_000_000):
                part = batch.column(1).slice(begin, end - begin)
                scores, spans = scorer.score(part) if scorer else (np.zeros(len(part)), [[] for _ in part])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin), pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(span))],
                    names=["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def drop_toxic(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores one half or more; all columns as they were."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for begin, end in byte_slices(batch.column(place), 2_000_000):
                part = batch.slice(begin, end - begin)
                if scorer:
                    scores, _ = scorer.score(part.column(place))
                    part = part.filter(pa.array(scores < 0.5))
                yield part

    return docs.mapInArrow(tidy(run), docs.schema)
