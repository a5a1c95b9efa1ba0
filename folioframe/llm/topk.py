"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are quantised to integers. Each block of vectors is indexed by segments:
the postings of one dimension, one absolute impact and one sign, all segments by
falling impact. A batch of queries adds segment after segment to its
accumulators. Between impacts the rest of a vector is bounded by the norm of its
components still to come and by the impact reached; once these bounds leave few
possible members of the top k, these are scored exactly and the block is done.
Nothing else ends a block early.

Blocks of vectors meet blocks of queries in a grid of cells of bounded size, one
task each; each cell reports its k best per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors and queries of a cell.
BLOCK = 4096
#: Queries scored side by side in a cell.
BATCH = 512
#: Possible members per query, in multiples of k, that are scored rather than narrowed further.
ENOUGH = 8


class ImpactIndex:
    """Postings of integer vectors (rows of ``vectors``), by falling absolute impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        doc, dim = np.nonzero(vectors)
        value = vectors[doc, dim]
        order = np.lexsort((doc, value, dim, -np.abs(value)))
        self.doc, dim, value = doc[order], dim[order], value[order]
        cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(value) != 0)) + 1
        self.starts = np.concatenate([[0], cuts]).astype(np.int64) if len(value) else np.empty(0, dtype=np.int64)
        self.ends = np.append(self.starts[1:], len(value)).astype(np.int64)
        self.dims, self.values = dim[self.starts], value[self.starts]

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, candidates that contain its k best and their exact scores; ``own`` (vectors × queries) marks excluded pairs."""
        n, m = len(self.vectors), len(queries)
        largest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).sum(axis=1).max(initial=0))
        kind = np.int32 if largest < 2**31 - 1 else np.int64
        scores = np.zeros((n, m), dtype=kind)
        weights = np.ascontiguousarray(queries.T).astype(kind)
        rest = (self.vectors.astype(float) ** 2).sum(axis=1)
        q_norm, q_sum = np.sqrt((queries.astype(float) ** 2).sum(axis=1)), np.abs(queries).astype(float).sum(axis=1)
        levels = np.abs(self.values)
        bounds = np.flatnonzero(np.append(levels[1:] != levels[:-1], True)) if len(levels) else []
        begin, check_at, total = 0, 0.6, len(self.doc)
        for last in bounds:
            for s in range(begin, last + 1):
                docs = self.doc[self.starts[s]:self.ends[s]]
                scores[docs] += self.values[s] * weights[self.dims[s]]
                rest[docs] -= float(self.values[s]) ** 2
            begin = last + 1
            if n > k and begin < len(levels) and self.ends[last] >= check_at * total:
                check_at += 0.1
                slack = np.minimum(np.sqrt(np.maximum(rest, 0) + 1e-6)[:, None] * q_norm, levels[begin] * q_sum)
                low = np.where(own, -np.inf, scores - slack)
                bar = np.partition(low, n - k, axis=0)[n - k]
                possible = (scores + slack >= bar) & ~own
                if possible.sum() <= ENOUGH * k * m:
                    return [self._exact(np.flatnonzero(possible[:, j]), queries[j]) for j in range(m)]
        return [(rows := np.flatnonzero(~own[:, j]), scores[rows, j].astype(np.int64)) for j in range(m)]

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows, self.vectors[rows] @ query


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with floor(scale * x) of every component; vectors that are null or have a null or non-finite one are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", finite)).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    one = lists.combine_chunks()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    lengths = one.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = one.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest integer inner products of each query, all if fewer.

    Queries are the rows for which ``is_query`` (over ``vec_id``) holds, candidates all rows with
    another id. Equal scores go to the smaller id. A row that repeats is a
    candidate, and if asked a query, each time. Rows with a null id are
    candidates after all others of equal score, never queries. Vectors of
    different lengths are compared over the components both have; an empty
    vector scores 0. An empty table gives an empty result.
    """
    table = quantised(vectors, id_col, vector_col, scale)
    asked = table.where(is_query).withColumn("query", F.monotonically_increasing_id())
    sizes = table.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("m")).first()
    rows, columns = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["m"] // block))
    spread = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = table.withColumn("query", F.lit(None).cast("long")).withColumn("i", spread(rows)).withColumn("j", every(columns))
    asking = asked.withColumn("j", spread(columns)).withColumn("i", every(rows))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(group: pa.Table) -> pa.Table:
        is_asked = group["query"].is_valid()
        docs, queries = group.filter(pa.compute.invert(is_asked)), group.filter(is_asked)
        width = max([0, *(pa.compute.max(t["v"].combine_chunks().value_lengths()).as_py() or 0 for t in (docs, queries) if len(t))])
        if not len(docs) or not len(queries):
            return schema.empty_table()
        doc_ids = docs["vec_id"].to_pandas().astype("Int64")
        null = doc_ids.isna().to_numpy()
        names = doc_ids.fillna(0).to_numpy(dtype=np.int64)
        order = np.lexsort((names, null))  # by id, null ids last: equal scores then go to the earlier row
        names, null = names[order], null[order]
        index = ImpactIndex(_matrix(docs["v"], width)[order])
        q_rows, q_ids, q = queries["query"].to_numpy(), queries["vec_id"].to_numpy(), _matrix(queries["v"], width)
        out = []
        for begin in range(0, len(q), BATCH):
            part = slice(begin, begin + BATCH)
            own = (names[:, None] == q_ids[part]) & ~null[:, None]
            for j, (found, score) in enumerate(index.search(q[part], k, own), begin):
                best = np.lexsort((found, -score))[:k]
                out.append((np.full(len(best), q_rows[j]), np.full(len(best), q_ids[j]), found[best], score[best]))
        columns_ = [np.concatenate(x) for x in zip(*out)]
        ids = pa.array(names[columns_[2]], mask=null[columns_[2]])
        return pa.Table.from_arrays([pa.array(columns_[0]), pa.array(columns_[1]), ids, pa.array(columns_[3])], schema=schema)

    found = held.unionByName(asking).groupBy("i", "j").applyInArrow(cell, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
