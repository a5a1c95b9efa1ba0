"""Language by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded
with zeros. Filters of several widths slide over a window, max pooling keeps
their highest answer, a softmax layer gives the languages. A document's scores
are the mean of its windows' probabilities, weighted by bytes. The network is
trained in numpy, in one task, on a bounded sample of labelled documents.

A filter over one-hot bytes is a sum of table rows, one per byte of its width;
rows of byte pairs are added up beforehand, which halves the look-ups.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.llm.base import arrow_map, few_by_hash, hash_order, hint_small, slices, written

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: Bytes convolved at once.
BLOCK_BYTES = 1 << 16


@dataclass
class ByteNet:
    """``filters[w]`` is (w, 256, n); ``dense`` maps the pooled answers to languages."""

    languages: list[str]
    window: int
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def __post_init__(self):
        self.pairs = None

    def _tables(self):
        """Per width, the summed rows of byte pairs (and of a last single byte)."""
        if self.pairs is None:
            self.pairs = {
                w: [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else f[k] for k in range(0, w, 2)]
                for w, f in self.filters.items()}
        return self.pairs

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Highest answer of every filter in every window, after ReLU."""
        places = np.ascontiguousarray(windows.T)  # position first: pooling then runs along whole rows
        pair = places[:-1].astype(np.uint16) * 256 + places[1:]
        out = []
        for w, tables in self._tables().items():
            n = len(places) - w + 1
            total = None
            for j, table in enumerate(tables):
                rows = table.take((pair if len(table) == 65536 else places)[2 * j:2 * j + n], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            out.append(total.max(axis=0))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows) @ self.dense + self.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities of all windows of each text, weighted by bytes."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        counts = np.maximum(1, -(-lengths // self.window))
        scores = np.zeros((len(texts), len(self.languages)))
        step = max(1, BLOCK_BYTES // self.window)
        pending: list[tuple[int, bytes]] = []

        def flush():
            raw = np.frombuffer(b"".join(b.ljust(self.window, b"\0") for _, b in pending), dtype=np.uint8).reshape(-1, self.window)
            weight = np.array([max(1, len(b)) for _, b in pending], dtype=float)
            np.add.at(scores, [i for i, _ in pending], self.probabilities(raw) * weight[:, None])
            pending.clear()

        for i, text in enumerate(texts):
            for k in range(int(counts[i])):
                pending.append((i, text[k * self.window:(k + 1) * self.window]))
                if len(pending) == step:
                    flush()
        if pending:
            flush()
        return scores / np.maximum(lengths, 1)[:, None]


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. ``per_language`` documents of up to ``most_bytes`` bytes are the sample."""

    per_language: int = 600
    most_bytes: int = 200_000
    windows_per_document: int = 6
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.004
    seed: int = 7


def fit(texts: list[bytes], labels: list[str], settings: Training = Training()) -> ByteNet:
    """Trains the network by Adam on windows of the texts, spread evenly over each; the order of the rows is taken as given."""
    random = np.random.default_rng(settings.seed)
    languages = sorted(set(labels))
    size = settings.window
    windows, truth = [], []
    for text, label in zip(texts, labels):
        starts = range(0, max(1, len(text)), size)
        chosen = starts if len(starts) <= settings.windows_per_document else [
            starts[j] for j in np.linspace(0, len(starts) - 1, settings.windows_per_document).astype(int)]
        for start in chosen:
            windows.append(text[start:start + size].ljust(size, b"\0"))
            truth.append(languages.index(label))
    data = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, size) if windows else np.zeros((0, size), np.uint8)
    truth = np.array(truth, dtype=np.int64)
    total = settings.filters * len(settings.widths)
    net = ByteNet(
        languages, size, {w: random.normal(0, 0.15, (w, 256, settings.filters)).astype(np.float32) for w in settings.widths},
        np.zeros(total, np.float32), random.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return net
    weights = [*net.filters.values(), net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    balance = len(truth) / (len(languages) * np.maximum(np.bincount(truth, minlength=len(languages)), 1))
    steps = 0
    for _ in range(settings.epochs):
        order = random.permutation(len(data))
        for begin in range(0, len(order), settings.batch):
            rows = order[begin:begin + settings.batch]
            x, y = data[rows], truth[rows]
            answers, places = [], []
            for w in settings.widths:
                n = size - w + 1
                sums = sum(net.filters[w][k][x[:, k:k + n]] for k in range(w))
                places.append(sums.argmax(axis=1))
                answers.append(np.take_along_axis(sums, places[-1][:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(answers, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.dense + net.dense_bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            delta = e / e.sum(axis=1, keepdims=True)
            delta[np.arange(len(y)), y] -= 1
            delta *= (balance[y] / len(y))[:, None]
            back = (delta @ net.dense.T) * (raw > 0)
            grads = []
            for j, w in enumerate(settings.widths):
                part = back[:, j * settings.filters:(j + 1) * settings.filters]
                grad = np.zeros_like(net.filters[w])
                for k in range(w):
                    byte = np.take_along_axis(x, places[j] + k, axis=1)
                    np.add.at(grad[k], (byte, np.broadcast_to(np.arange(settings.filters), byte.shape)), part)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            steps += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= settings.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def train(docs: DataFrame, learnable: Column, settings: Training = Training(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> ByteNet | None:
    """The network learned from rows where ``learnable`` holds and the language is known; None without any.

    The sample is the ``per_language`` documents with the smallest hash of the
    id in each language; of rows that share an id and language one is taken.
    Training runs in one task over the sample alone.
    """
    usable = docs.where(learnable & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= settings.most_bytes) & (F.length(text_col) > 0))
    ids = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id IS NOT NULL")
    totals = ids.groupBy("lang").agg(F.count("*").alias("total"))
    # a row per language: the hash filter runs where the ids are read
    few = ids.join(hint_small(written(totals, "languages")), "lang").where(few_by_hash("id", settings.per_language, F.col("total"))).select("id", "lang").distinct()
    by_hash = Window.partitionBy("lang").orderBy(*hash_order("id"))
    chosen = few.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= settings.per_language).drop("place")
    sample = usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.max("text").alias("text"))

    def run(batches):
        rows = [r for pdf in batches for r in zip(pdf["id"], pdf["lang"], pdf["text"])]
        if rows:
            rows.sort(key=lambda r: (str(r[1]), r[0]))
            yield pd.DataFrame({"net": [pickle.dumps(fit([t.encode() for *_, t in rows], [lang for _, lang, _ in rows], settings))]})

    out = sample.coalesce(1).mapInPandas(run, "net binary").collect()
    return pickle.loads(out[0]["net"]) if out else None


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: language and its probability over all windows of the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. Rows that repeat stay; equal scores go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batch: pa.RecordBatch):
        net = shared.value
        texts = batch.column(1).to_pylist()
        for begin, end in slices(texts):
            part = texts[begin:end]
            asked = [i for i, t in enumerate(part) if net and t and LETTER.search(t)]
            languages, scores = [UNDETERMINED] * len(part), [0.0] * len(part)
            if asked:
                found = net.document_scores([part[i].encode() for i in asked])
                for i, best, row in zip(asked, found.argmax(axis=1), found):
                    languages[i], scores[i] = net.languages[best], min(1.0, float(row[best]))
            yield {"doc_id": batch.column(0).slice(begin, end - begin), "lang_pred": languages, "score": scores}

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, work, "doc_id long, lang_pred string, score double",
                     pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))
