"""SentencePiece encoding and decoding by a Viterbi walk that shares prefixes.

Text is marked (a mark for every space and one in front) and cut into words
before each run of marks; no piece crosses such a cut, so words are independent.
The distinct words of a slice are sorted, which is a depth-first walk of their
trie: the forward scores of the prefix a word shares with the one before it are
kept, and only the new characters are scored. Characters without a piece become
their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import WordValues, arrow_map, byte_slices, flat_lists, gather

MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with their scores and ids, byte ids, and the bytes every id decodes to."""

    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        scores, decoded, byte_ids = {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                decoded.append(b"")
            else:
                scores[piece] = (model.get_score(i), i)
                decoded.append(piece.replace(MARK, " ").encode())
        if any(MARK in piece.lstrip(MARK) for piece in scores):
            raise ValueError("a piece crosses a word border")
        lengths = np.array([len(b) for b in decoded], dtype=np.int64)
        return cls(scores, byte_ids, np.frombuffer(b"".join(decoded), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)

    def __post_init__(self):
        #: endings of pieces: a longer ending than any of these has no piece
        self.endings = {piece[i:] for piece in self.scores for i in range(len(piece))}
        self.unknown = min(score for score, _ in self.scores.values()) - UNKNOWN_PENALTY

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of ``words``, which are marked and in ascending order.

        Equal scores go to the longest last piece.
        """
        scores, endings, unknown = self.scores, self.endings, self.unknown
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]  # where the last piece begins, its id; -1: unknown
        before, out = "", []
        for word in words:
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, at, piece_id = best[end - 1] + unknown, end - 1, -1
                begin = end - 1
                while begin >= 0:
                    part = word[begin:end]
                    if part not in endings:
                        break
                    found = scores.get(part)
                    if found and best[begin] + found[0] >= top:
                        top, at, piece_id = best[begin] + found[0], begin, found[1]
                    begin -= 1
                best.append(top)
                back.append((at, piece_id))
            before = word
            ids, end = [], len(word)
            while end:
                at, piece_id = back[end]
                if piece_id < 0:
                    ids.extend(self.byte_ids[b] for b in reversed(word[at:end].encode()))
                else:
                    ids.append(piece_id)
                end = at
            out.append(ids[::-1])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text, without the space that marks its beginning."""
        data = gather(self.flat, self.starts[ids], self.lengths[ids]).tobytes()
        return data[1:] if data[:1] == b" " else data


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts with a mark for every space and one in front, cut before each run of marks.

    The distinct words, the number in them of every word of all texts behind one
    another, and the words of each text. A mark of the text itself is a mark
    like any other. An empty or null text has no word.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
    parts = pc.split_pattern(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, texts, "")), MARK)
    coded = parts.flatten().dictionary_encode()
    fields, codes = coded.dictionary, coded.indices.to_numpy()
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    empty = pc.index(fields, pa.scalar("", fields.type)).as_py()
    # the first field of a text stands before its first mark; a word ends with a field that is not empty, or with the text
    ending = codes != empty
    ending[ends[sizes > 1] - 1] = True
    counts = np.add.reduceat(ending, ends - sizes, dtype=np.int64) if len(sizes) else sizes
    heads = np.zeros(len(codes), dtype=bool)
    heads[ends - sizes] = True
    at, border = np.flatnonzero(ending), np.flatnonzero(ending | heads)
    marks = at - border[np.searchsorted(border, at) - 1]  # as many as fields since the word before, or since the head
    simple = pc.binary_join_element_wise(MARK, fields, "")
    longer = np.flatnonzero(marks != 1)
    codes = codes[at].astype(np.int64)
    extra, place = np.unique(np.stack([codes[longer], marks[longer]], axis=1), axis=0, return_inverse=True)
    codes[longer] = len(fields) + place.reshape(-1)
    more = pa.array([MARK * int(n) + fields[int(c)].as_py() for c, n in extra], fields.type)
    return pa.concat_arrays([simple, more]), codes, counts


_LOADED: dict[str, tuple[Vocabulary, WordValues]] = {}


def _loaded(path: str) -> tuple[Vocabulary, WordValues]:
    """Vocabulary and word cache of a worker process; the cache is bounded."""
    if path not in _LOADED:
        vocabulary = Vocabulary.load(path)

        def ids_of(new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            words = new.to_pylist()
            order = sorted(range(len(words)), key=words.__getitem__)
            ids: list = [None] * len(words)
            for i, one in zip(order, vocabulary.encode_sorted([words[i] for i in order])):
                ids[i] = one
            return flat_lists(ids, np.int32)

        _LOADED[path] = vocabulary, WordValues(ids_of, np.int32)
    return _LOADED[path]


def encode_texts(texts: list[str | None] | pa.Array, path: str) -> list[np.ndarray]:
    """Ids of each text; an empty or null text has none."""
    _, cache = _loaded(path)
    ids, counts = cache.of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), marked_words)
    return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


def decode_ids(parts: list[np.ndarray], path: str) -> list[str]:
    """Texts of id sequences; bytes that are no UTF-8 become replacement characters."""
    vocabulary, _ = _loaded(path)
    return [vocabulary.decode(np.asarray(p, dtype=np.int64)).decode(errors="replace") for p in parts]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``; a null or empty text has an empty list. Rows that repeat stay, texts are encoded whole."""

    def work(batch: pa.RecordBatch):
        for begin, end in byte_slices(batch.column(1)):
            parts = encode_texts(batch.column(1).slice(begin, end - begin), path)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = pa.array(np.concatenate(parts).astype(np.int32), pa.int32())
            yield {"doc_id": batch.column(0).slice(begin, end - begin), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, work, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of id lists; a null list is an empty text."""

    def work(batch: pa.RecordBatch):
        lists = batch.column(1)
        yield {"doc_id": batch.column(0), "text": decode_ids([np.array(x.as_py() or [], dtype=np.int64) for x in lists], path)}

    source = ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return arrow_map(source, work, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def encoding_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256, round_trip``: the encoding, and what decoding its ids gives.

    Ids are little-endian unsigned 32-bit for the checksum. ``round_trip`` is
    false only for texts that hold the mark itself, which decodes to a space.
    """

    def work(batch: pa.RecordBatch):
        vocabulary, _ = _loaded(path)
        for begin, end in byte_slices(batch.column(1)):
            part = batch.column(1).slice(begin, end - begin)
            ids = encode_texts(part, path)
            back = [vocabulary.decode(p) for p in ids]
            yield {
                "doc_id": batch.column(0).slice(begin, end - begin), "n_ids": [len(p) for p in ids],
                "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in ids],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                "round_trip": [b == (t or b"") for b, t in zip(back, part.cast(pa.binary()).to_pylist())],
            }

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(
        source, work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean",
        pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]))
