"""Best-fit packing of token pieces under several capacities.

A sequence has a capacity of tokens, of documents and of attention cost (the sum
of squared piece lengths). A piece goes to the open sequence with the best
score among those where it fits in every dimension: the largest weighted dot
product of piece and residual capacity, or the smallest norm of what would be
left. Pieces are taken by falling length, so full ones close a sequence at once.

Tokenizing runs over the input where it lies; what follows moves only ids,
lengths and checksums. Pieces are dealt at random to groups of bounded size and
packed group by group, so no group grows with the corpus.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import WordValues, arrow_map, byte_slices, flat_lists, gather, written

#: Pieces of a group, about; each group leaves one sequence partly filled.
GROUP_PIECES = 20_000
#: ASCII punctuation without the apostrophe, which may begin a run with letters.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_CACHES: dict[str, tuple] = {}


class WordEncoder:
    """Ids of words by a tokenizer that lower-cases, cuts letters from other characters, and marks the last piece of every run.

    Words of letters alone are one run each, so many of them are encoded as one
    text, whose marked pieces tell them apart. ASCII punctuation behind a word
    (but an apostrophe) is a run of its own.
    """

    TOGETHER = 200

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words of letters."""
        names = words.to_pylist()
        groups = [names[i:i + self.TOGETHER] for i in range(0, len(names), self.TOGETHER)]
        ids, lengths = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for group, found in zip(groups, self._each([" ".join(g) for g in groups])):
            flat = np.array(found, dtype=np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(group) and ends[-1] == len(flat):
                count = np.diff(ends, prepend=0)
            else:  # a letter that the tokenizer takes for something else
                flat, count = flat_lists(self._each(group), np.uint32)
            ids.append(flat)
            lengths.append(count)
        return np.concatenate(ids), np.concatenate(lengths)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind one another, and the number of each."""
        heads = pc.ascii_rtrim(words, characters=TAIL)
        heads = pc.if_else(pc.match_substring_regex(heads, "[A-Za-z]$"), heads, words)  # ASCII letters compose with nothing that follows
        simple = pc.match_substring_regex(heads, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        flat, lengths = self._letters(heads.filter(pa.array(simple)))
        other, other_lengths = flat_lists(self._each(heads.filter(pa.array(~simple)).to_pylist()), np.uint32)
        # heads and tails behind one another, in the order of the words
        tailed = np.flatnonzero(pc.not_equal(heads, words).to_numpy(zero_copy_only=False))
        rows = pa.array(tailed)
        tails = [w[len(h):] for w, h in zip(words.take(rows).to_pylist(), heads.take(rows).to_pylist())]
        known = sorted(set(tails))
        tail_ids, tail_lengths = flat_lists(self._each(known), np.uint32)
        number = {t: i for i, t in enumerate(known)}
        which = np.fromiter((number[t] for t in tails), dtype=np.int64, count=len(tails))
        everything = np.concatenate([flat, other, tail_ids])
        of_heads, n = np.empty(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        n[simple], n[~simple] = lengths, other_lengths
        of_heads[simple], of_heads[~simple] = np.cumsum(lengths) - lengths, len(flat) + np.cumsum(other_lengths) - other_lengths
        of_tails = len(flat) + len(other) + np.cumsum(tail_lengths) - tail_lengths
        starts, sizes = np.insert(of_heads, tailed + 1, of_tails[which]), np.insert(n, tailed + 1, tail_lengths[which])
        total = n.copy()
        total[tailed] += tail_lengths[which]
        return gather(everything, starts, sizes), total


def _tokenizer(path: str):
    """Tokenizer and word cache of a worker process, loaded once; the cache is bounded."""
    if path not in _CACHES:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _CACHES[path] = tokenizer, WordValues(WordEncoder(tokenizer), np.uint32)
    return _CACHES[path]


def word_token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind one another and their number per text; a null text has none.

    For a tokenizer that splits at white space and lower-cases: words between
    ASCII white space are independent, so each distinct one is encoded once.
    Texts that may hold a special token are encoded whole.
    """
    tokenizer, cache = _tokenizer(path)
    special = pc.fill_null(pc.match_substring(texts, "<|"), False)
    ids, counts = cache.of(pc.if_else(special, "", texts))
    rows = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
    if rows:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in rows:
            parts[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
    return ids, counts


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``.

    A document is its token ids and ``end_id``; a null or empty text is
    ``end_id`` alone. Only longer documents are cut.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))

    def work(batch: pa.RecordBatch):
        names = batch.column(0).to_pylist()
        for begin, end in byte_slices(batch.column(1), 3_000_000):
            ids, counts = word_token_ids(batch.column(1).slice(begin, end - begin), tokenizer_path)
            out: dict[str, list] = {name: [] for name, _ in fields}
            at = 0
            for name, n in zip(names[begin:end], counts.tolist()):
                one = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, n + 1, max_tokens)):
                    part = one[start:start + max_tokens]
                    for field, value in zip(out, (name, piece, start, len(part), zlib.crc32(part), part.tolist() if with_ids else None)):
                        out[field].append(value)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, work, schema, pa.schema(fields))


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence and the weights of its dimensions; ``rule`` is ``dot`` or ``norm``."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.5, 0.25)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)


def pack(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Sequence number of each piece, by vector best fit over falling lengths.

    Sequences with equal residuals are interchangeable, so open sequences are
    kept as states with a stack of their numbers. Equal scores go to the smaller
    residual of tokens, then documents, then attention.
    """
    limits = capacity.limits()
    if len(lengths) and (lengths.max() > capacity.tokens or int(lengths.max()) ** 2 > capacity.attention or capacity.documents < 1):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    scale = np.array(capacity.weights) / limits**2
    bins = np.empty(len(lengths), dtype=np.int64)
    states = np.empty((64, 3), dtype=np.int64)  # residuals of the first `used` states
    members: list[list[int]] = []
    where: dict[tuple, int] = {}
    used = opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        need = np.array([n, 1, n * n])
        left = states[:used] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            if capacity.rule == "dot":
                score = -(states[fits] * (need * scale)).sum(axis=1)
            else:
                score = (left[fits].astype(float) ** 2 * scale).sum(axis=1)
            best = fits[score == score.min()]
            state = int(best[np.lexsort(states[best].T[::-1])[0]]) if len(best) > 1 else int(best[0])
            number, residual = members[state].pop(), left[state]
            if not members[state]:  # the last state takes the empty place
                del where[tuple(states[state].tolist())]
                used -= 1
                if state != used:
                    states[state], members[state] = states[used], members[used]
                    where[tuple(states[state].tolist())] = state
                members.pop()
        else:
            number, residual = opened, limits - need
            opened += 1
        bins[i] = number
        if residual[0] and residual[1] and residual[2]:
            key = tuple(residual.tolist())
            if key not in where:
                if used == len(states):
                    states = np.concatenate([states, np.empty_like(states)])
                states[used], where[key] = residual, used
                members.append([])
                used += 1
            members[where[key]].append(number)
    return bins


def packed(pieces: DataFrame, capacity: Capacity, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every sequence is within ``capacity`` and gapless from 0.

    Pieces need the columns of :func:`token_pieces`. Repeated rows are separate
    pieces; an empty table gives an empty result.
    """
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(group: pa.Table) -> pa.Table:
        lot = group["lot"][0].as_py()
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]
        group = group.drop_columns(["lot"]).sort_by(order)
        lengths = group["length"].to_numpy()
        bins = pack(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        heads = np.concatenate([[True], np.diff(bins[order]) != 0])
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(heads, before, 0))
        return group.append_column("sequence_id", pa.array((lot << 32) + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("lot").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: Capacity | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Documents as packed pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text: empty, one piece of one id. A null doc_id stays null. Very long
    texts give many pieces. Ties and repeated rows: each row is packed on its own.
    """
    capacity = capacity or Capacity()
    return packed(token_pieces(docs, tokenizer_path, capacity.tokens), capacity, group_pieces)
