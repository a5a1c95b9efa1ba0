"""Spelling variants: words one edit apart, found by neighbourhoods over a reduced alphabet.

Every letter is hashed to one of a few symbols. Words one edit apart have
reduced words that are equal or one edit apart, so the reduced words within one
edit of a reduced word are generated, joined with the reduced vocabulary, and
what meets is verified on the original strings.

The neighbourhood of a reduced word is itself, its replacements, deletions and
insertions. An insertion of one word is a deletion of the other, and so is the
replacement by a higher symbol that by a lower one: of two words that can meet
the longer one asks, or the one with the lower symbol, so that each pair is met
under one key and half of the neighbourhood has to be moved. Keys are hashes of
reduced words, which only ever adds candidates.

The number of symbols grows with the vocabulary, so that few words share a key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import bounded_batches, byte_slices, text_bytes, tidy, written

SLICE_BYTES = 8_000_000
_MASK = (1 << 64) - 1
#: The base of the hash of reduced words, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
LENGTHS = 0xC2B2AE3D27D4EB4F
#: Lead byte of the UTF-8 form of U+00C0 to U+00FF.
LEAD = 0xC3
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == LEAD else 32 for b in range(256))


def _crc_step(crc: int) -> int:
    """A checksum after one more zero byte, without the inversions."""
    for _ in range(8):
        crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _shift_tables(most: int) -> np.ndarray:
    """(length, 4, 256): what each byte of a checksum becomes after so many more bytes."""
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    step = np.array([_crc_step(b) for b in range(256)], dtype=np.uint32)
    for n in range(most):
        low, high = out[n] & np.uint32(255), out[n] >> np.uint32(8)
        out[n + 1] = high ^ step[low]
    return out


class Checksums:
    """crc32 of a prefix and a word for many pairs, from the checksums of both."""

    MOST = 64

    def __init__(self):
        self.tables = _shift_tables(self.MOST)

    def joined(self, prefix_crcs: np.ndarray, word_crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For words of at most ``MOST`` bytes."""
        out = word_crcs.copy()
        for k in range(4):
            out ^= self.tables[lengths, k, prefix_crcs >> np.uint32(8 * k) & np.uint32(255)]
        return out


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased: the distinct ones, the number of each run, and the text of each."""
    offsets, data = text_bytes(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    kept = np.frombuffer(data.translate(_LETTERS), dtype=np.uint8).copy()
    second = np.flatnonzero(raw == LEAD) + 1
    kept[second] = raw[second]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(kept))
    parts = pc.ascii_split_whitespace(plain)
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        full = codes != empty
        codes, of = codes[full], of[full]
    return words, codes, of


def altered(word: str, checksum: int, divisor: int) -> str:
    """The word without the letter that its checksum names, if ``divisor`` divides the checksum."""
    if checksum % divisor:
        return word
    k = checksum % len(word)
    return word[:k] + word[k + 1:]


def word_counts(docs: DataFrame, least_length: int, divisor: int) -> DataFrame:
    """``word, n`` of ``docs`` (doc_id as text, text) with at least ``least_length`` letters, after letters were deleted."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for batch in batches:
            for begin, end in byte_slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                words, codes, of = letter_runs(part.column(1))
                if not len(codes):
                    continue
                raw = words.cast(pa.binary()).to_pylist()
                sizes, letters = pc.binary_length(words).to_numpy(), pc.utf8_length(words).to_numpy()
                crcs = np.fromiter(map(zlib.crc32, raw), dtype=np.uint32, count=len(raw))
                prefixes = [f"{i}:".encode() for i in part.column(0).to_pylist()]
                heads = np.fromiter(map(zlib.crc32, prefixes), dtype=np.uint32, count=len(prefixes))
                joined = sums.joined(heads[of], crcs[codes], np.minimum(sizes, sums.MOST)[codes])
                for i in np.flatnonzero(sizes[codes] > sums.MOST).tolist():
                    joined[i] = zlib.crc32(raw[codes[i]], int(heads[of[i]]))
                hit = joined % np.uint32(divisor) == 0
                plain = np.bincount(codes[~hit], minlength=len(words))
                changed = Counter(altered(raw[c].decode(), int(h), divisor) for c, h in zip(codes[hit].tolist(), joined[hit].tolist()))
                used = np.flatnonzero((plain > 0) & (letters >= least_length))
                more = [(w, n) for w, n in changed.items() if len(w) >= least_length]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(used)), pa.array(plain[used], pa.int64())], schema=schema)
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in more], pa.string()), pa.array([n for _, n in more], pa.int64())], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols_for(words: int, least: int = 4, most: int = 16, length: int = 7) -> int:
    """So many symbols that reduced words of ``length`` letters are about as many as ``words``."""
    return int(min(most, max(least, np.ceil(max(1, words) ** (1 / length)))))


def reduced(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words behind one another, from 1 up, and the length of each word."""
    table = np.array([(((b * 0x9E3779B1) & 0xFFFFFFFF) >> 16) % symbols + 1 for b in range(256)], dtype=np.uint64)
    flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8)  # U+0000 to U+00FF: one byte a letter
    return table[flat], pc.utf8_length(words).to_numpy().astype(np.int64)


def neighbourhood(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the reduced words themselves; and the words' other keys, each with the number of its word.

    The others are the deletions and the replacements by a higher symbol. A word
    has each key once.
    """
    symbol, lengths = reduced(words, symbols)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(symbol)) - starts[of]
    powers = np.ones(int(lengths.max(initial=0)) + 1, dtype=np.uint64)
    powers[1:] = np.uint64(BASE)
    powers = np.cumprod(powers, dtype=np.uint64)
    worth = symbol * powers[place]
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(worth, dtype=np.uint64)])
    whole = running[starts + lengths] - running[starts]
    own = whole + lengths.astype(np.uint64) * np.uint64(LENGTHS)
    front = running[:-1] - running[starts[of]]
    back = (whole[of] - front - worth) * np.uint64(UNBASE)
    # of letters of equal symbols side by side, one deletion is enough
    alone = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])]) if len(symbol) else np.zeros(0, dtype=bool)
    deleted = (front + back + (lengths[of] - 1).astype(np.uint64) * np.uint64(LENGTHS))[alone]
    keys, names = [deleted], [of[alone]]
    for higher in range(2, symbols + 1):
        at = symbol < higher
        keys.append(own[of[at]] + (np.uint64(higher) - symbol[at]) * powers[place[at]])
        names.append(of[at])
    return own.view(np.int64), np.concatenate(keys).view(np.int64), np.concatenate(names)


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """Pairs ``a, b`` with ``n_a, n_b`` of the distinct ``words`` (word, n) that differ by one inserted, deleted or replaced letter; each pair once."""
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def keys(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 5_000):
                    part = batch.slice(at, 5_000)
                    own, key, of = neighbourhood(part.column(0), symbols)
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array(own), *part.columns], schema=schema)
                    else:
                        rows = pa.array(of)
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(rows), part.column(1).take(rows)], schema=schema)

        return words.select("word", "n").mapInArrow(tidy(run), "key long, word string, n long")

    known = written(keys(True), "reduced")
    there = known.hint("merge").alias("b")  # the vocabulary grows with the corpus: it is never broadcast
    one = F.expr("levenshtein(a.word, b.word, 1) = 1")
    asks = keys(False).alias("a").join(there, (F.col("a.key") == F.col("b.key")) & one)
    same = known.alias("a").join(there, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & one)
    columns = [F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")]
    return asks.select(*columns).unionAll(same.select(*columns))


def last_forms(links: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, by doubling: every round follows as many forms as all rounds before."""
    links = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, divisor: int = 97, ratio: int = 2, symbols: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of at least ``least_length`` letters that occurs ``least_count`` times.

    Runs of letters whose checksum with the document's id ``divisor`` divides
    lose a letter first. ``n_near`` counts the words one edit apart; ``form`` is
    the one of them that occurs most (ties: first in code-point order) if it
    occurs at least ``ratio`` times as often, and ``root`` the last of the chain
    of forms, the word itself if it has none. As ``ratio`` is 2 or more, a chain
    gets more frequent at every step: it ends.

    A null text has no words, a null id counts as the empty text; texts are read
    whole, rows that repeat count each; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = written(word_counts(rows, least_length, divisor).where(F.col("n") >= least_count), "words")
    pairs = written(near_words(words, symbols or symbols_for(words.count())), "near")
    ends = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")).alias("near")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("form")).alias("near")))
    best = ends.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("top"))
    is_form = -F.col("top.less") >= ratio * F.col("n")
    best = written(best.select("word", "n_near", F.when(is_form, F.col("top.form")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n")), "best")
    roots = last_forms(best.where("form IS NOT NULL"))
    return words.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
