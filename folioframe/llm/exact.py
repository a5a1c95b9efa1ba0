"""Exact duplicates: counting quotient filters route fingerprints to byte verification.

A document's 64-bit fingerprint is split into a quotient (high bits) and a
remainder (low bits). Every partition builds a filter of its own fingerprints:
one occupied bit per quotient that has any, one run-end bit and one counter per
stored remainder, remainders sorted inside their run. Nothing of the 64 bits is
lost, so filters merge without loss by a walk over both in sorted order. The
filters are cut into ranges of quotients; each range is merged in one task of
bounded size. Fingerprints counted more than once send their documents to byte
verification, a grouping by the normalised text itself; all others are unique.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import KEY, arrow_map, hint_small, in_files, key_columns, slices, without_rows, written

#: Fingerprints per range of quotients, on average; a range is one task's work.
RANGE_SIZE = 1 << 19


@dataclass
class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints without loss.

    ``first`` is the first quotient of the range, ``bits`` the number of
    remainder bits. ``occupied`` has one bit per quotient of the range,
    ``run_end`` one bit per slot.
    """

    bits: int
    first: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, bits: int, first: int, quotients: int, counts: np.ndarray | None = None) -> QuotientFilter:
        """``prints`` are uint64 in the range of ``quotients`` quotients from ``first``; with ``counts``, each has its own."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        weights = np.ones(len(prints), dtype=np.int64) if counts is None else counts[order]
        heads = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.empty(0, dtype=np.int64)
        distinct = prints[heads]
        summed = np.add.reduceat(weights, heads) if len(heads) else weights
        quotient = (distinct >> np.uint64(bits)).astype(np.int64) - first
        occupied = np.zeros(quotients, dtype=bool)
        occupied[quotient] = True
        run_end = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if len(quotient) else np.empty(0, dtype=bool)
        return cls(bits, first, occupied, run_end, distinct & np.uint64((1 << bits) - 1), summed)

    def prints(self) -> np.ndarray:
        """The stored fingerprints in ascending order."""
        runs = np.flatnonzero(self.occupied).astype(np.uint64) + np.uint64(self.first)
        run_of = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64) if len(self.run_end) else np.empty(0, dtype=np.int64)
        return (runs[run_of] << np.uint64(self.bits)) | self.remainders

    def merge(self, others: list[QuotientFilter]) -> QuotientFilter:
        """Lossless union; equal fingerprints add their counts."""
        parts = [self, *others]
        return QuotientFilter.build(
            np.concatenate([p.prints() for p in parts]), self.bits, self.first, len(self.occupied),
            np.concatenate([p.counts for p in parts]))

    def repeated(self) -> np.ndarray:
        return self.prints()[self.counts > 1]

    def dumps(self) -> bytes:
        head = np.array([self.bits, self.first, len(self.occupied), len(self.run_end)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_end), self.remainders, self.counts))

    @classmethod
    def loads(cls, data: bytes) -> QuotientFilter:
        bits, first, quotients, slots = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=4))
        at = 32
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, -(-quotients // 8), at), count=quotients).astype(bool)
        at += -(-quotients // 8)
        run_end = np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at), count=slots).astype(bool)
        at += -(-slots // 8)
        remainders = np.frombuffer(data, np.uint64, slots, at)
        return cls(bits, first, occupied, run_end, remainders, np.frombuffer(data, np.int64, slots, at + 8 * slots))


def _prints(rows: DataFrame, with_text: bool) -> DataFrame:
    """Row, id, sha256 (hex) and 64-bit fingerprint of the text with A-Z lower-cased, and that text on request."""
    fields = [(k, pa.int64()) for k in KEY] + [("id", pa.int64()), ("sha", pa.string()), ("fp", pa.int64())] + [("body", pa.binary())] * with_text

    def work(batch: pa.RecordBatch):
        texts = batch.column(3).to_pylist()
        for begin, end in slices(texts):
            data = [(t or "").encode().lower() for t in texts[begin:end]]  # bytes.lower() changes A-Z alone
            yield {
                **{k: batch.column(i).slice(begin, end - begin) for i, k in enumerate([*KEY, "id"])},
                "sha": [hashlib.sha256(b).hexdigest() for b in data], "body": data,
                "fp": np.array([xxhash.xxh3_64_intdigest(b) for b in data], dtype=np.uint64).view(np.int64),
            }

    schema = f"{KEY[0]} long, {KEY[1]} long, id long, sha string, fp long" + ", body binary" * with_text
    return arrow_map(rows, work, schema, pa.schema(fields))


def repeated_prints(prints: DataFrame, n_rows: int, range_size: int = RANGE_SIZE) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, from merged filters."""
    ranges = 1 << max(0, math.ceil(math.log2(max(1, n_rows / range_size))))
    # about as many quotients as fingerprints, so that runs stay short
    quotient_bits = max(1, math.ceil(math.log2(max(2, n_rows))))
    bits = 64 - quotient_bits
    per_range = max(1, (1 << quotient_bits) // ranges)

    def build(batches):
        whole = [np.empty(0, dtype=np.uint64)]
        counts = [np.empty(0, dtype=np.int64)]
        size = 0
        for batch in batches:
            found, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            whole.append(found)
            counts.append(n)
            size += len(found)
            if size > 4 * range_size:  # a long partition gives several filters
                yield from cut(np.concatenate(whole), np.concatenate(counts))
                whole, counts, size = whole[:1], counts[:1], 0
        yield from cut(np.concatenate(whole), np.concatenate(counts))

    def cut(found, n):
        part = ((found >> np.uint64(bits)).astype(np.int64) // per_range)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(rows):
                k = int(part[rows[0]])
                one = QuotientFilter.build(found[rows], bits, k * per_range, per_range, n[rows])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([one.dumps()], pa.binary())], names=["range", "filter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (QuotientFilter.loads(x) for x in pdf["filter"])
        return pd.DataFrame({"fp": first.merge(rest).repeated().view(np.int64)})

    filters = prints.select("fp").mapInArrow(build, "range long, filter binary")
    return filters.groupBy("range").applyInPandas(merge, "fp long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_size: int = RANGE_SIZE) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256`` and the name of the row (``KEY``).

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one. Of equal texts the row with the largest id stays; a null id is
    smaller than any other, and a group of null ids has a null ``keep_id``.
    Where a row repeats with the same id and text, exactly one repetition is
    kept. An empty table gives an empty result; very long texts are hashed and
    compared whole.
    """
    rows = in_files(docs).select(*key_columns(), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = written(_prints(rows, False), "prints")
    repeated = written(repeated_prints(slim, slim.count(), range_size), "repeated")
    routed = _prints(rows, True).join(hint_small(repeated), "fp", "left_semi")
    # the grouping compares the bytes themselves
    texts = routed.groupBy("sha", "body").agg(F.max(F.struct("id", *KEY)).alias("top"), F.count("*").alias("n"))
    one_text = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(F.first("n"))
    classes = written(texts.where("n > 1").groupBy("sha").agg(F.first("top").alias("top"), one_text.alias("n")), "classes")
    is_top = (F.col(KEY[0]) == F.col(f"top.{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"top.{KEY[1]}"))
    return slim.join(classes, "sha", "left").select(
        *KEY, "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(is_top, F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep; all columns as they were."""
    docs = in_files(docs)
    return without_rows(docs, exact_groups(docs, id_col, text_col).where("not kept"))
