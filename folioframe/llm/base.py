"""What the corpus operators share: reading, text slices, caches of encoded words.

Conventions of every operator here: the columns it needs are selected by name
first, so further columns of the input cannot clash with what it adds; a null
text is an empty text unless the operator says otherwise; rows that repeat stay
separate rows.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import ensure_checkpoint_dir

#: Characters handled at once inside a task; bounds the temporaries, not the text.
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, remainder_of: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % remainder_of


def few_by_hash(column: str, wanted: int, total: Column | int) -> Column:
    """Keeps about four times ``wanted`` of ``total`` ids, those of small hash, and all of a few.

    A filter in front of "the ``wanted`` ids of smallest hash": what is left to
    sort is bounded, however many partitions the table has.
    """
    share = F.lit(4.0 * wanted + 100.0) / total
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


def hash_order(column: str) -> list[Column]:
    """The order in which :func:`few_by_hash` keeps ids."""
    return [F.pmod(F.xxhash64(column), F.lit(1 << 30)), F.col(column)]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns that name a row of a table in files: a hash of the file's path, and the row's place in the file.
KEY = ["in_file", "at_place"]
_PLAIN_NODES = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "Repartition", "RepartitionByExpression"}


def in_files(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows come one to one from Parquet files, else written as such.

    Rows of files have names that hold for every pass over them, however the
    files are split, also after executors were lost.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName().split(" ")[0] in _PLAIN_NODES and node.children().size() == 1:
        node = node.children().apply(0)
    if node.nodeName().split(" ")[0] == "LogicalRelation" and "parquet" in str(node.relation()).lower():
        return docs
    return written(docs, "rows")


def key_columns(names: list[str] = KEY) -> list[Column]:
    """The name of a row of :func:`in_files`."""
    return [F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]


#: Rows of a table of a few short columns that may be broadcast.
SMALL_ROWS = 500_000


def hint_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written slim table with a broadcast hint if it was counted to be small; else both sides are shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, which are :func:`in_files`, without the rows named in ``dropped``; columns as they were."""
    names = [f"{k}_{uuid.uuid4().hex[:8]}" for k in KEY]
    rows = written(dropped.select(*(F.col(k).alias(n) for k, n in zip(KEY, names))), "dropped")
    return docs.select(*docs.columns, *key_columns(names)).join(hint_small(rows), names, "left_anti").select(*docs.columns)


#: Arrow batches of texts, in place of Spark's defaults (before the arrow): a worker and its JVM hold several copies of one.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless its user has set their size."""
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def _release() -> None:
    """Gives back what the allocators of a worker keep for later: workers live on, and others of the machine need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches that leaves little memory behind it, during and after a task."""

    @functools.wraps(run)
    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()
        _release()

    return kept_small


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """``work`` yields column dicts for a record batch; the schema is given once for Spark, once for Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in ((columns[f.name], f) for f in arrow_schema)],
                    schema=arrow_schema)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` characters; a longer text is alone in its range."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + length]`` behind one another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0].copy()
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)]


def byte_slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """:func:`slices` of an Arrow array, by bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets (int32) and bytes of an array of strings, without what other slices hold; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1] if offsets else np.zeros(1, dtype=np.int32)
    return at - at[0], data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data else b""


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased.

    The distinct ones, the number in them of every word of all texts behind one
    another, and the words of each text. A null text has none.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # what is in front of leading white space, and behind trailing
        full = codes != empty
        counts = np.add.reduceat(full, np.cumsum(counts) - counts, dtype=np.int64)
        codes = codes[full]
        codes = codes - (codes > empty)
        distinct = pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return distinct, codes, counts


class WordValues:
    """A list of values for every word seen so far: the words are an Arrow array, the values lie flat.

    About 40 bytes a word. All are forgotten beyond ``limit`` words or values
    and begin anew with the next texts.
    """

    def __init__(self, values_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype: type, limit: int = 800_000):
        """``values_of`` new words: their values behind one another, and the number of each."""
        self.values_of, self.dtype, self.limit = values_of, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.empty(0, dtype=self.dtype)
        self.starts = np.empty(0, dtype=np.int32)
        self.lengths = np.empty(0, dtype=np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the values of distinct words are."""
        if max(len(self.words), len(self.flat) // 4) > self.limit:
            self.clear()
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        if len(new):
            values, lengths = self.values_of(new)
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.flat = np.concatenate([self.flat, values.astype(self.dtype)])
            at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
            at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            return at
        return found.to_numpy(zero_copy_only=False)

    def of(self, texts: pa.Array, split: Callable = words_in) -> tuple[np.ndarray, np.ndarray]:
        """Values of the words of all texts behind one another, and the number of each text."""
        words, codes, counts = split(texts)
        at = self.places(words)[codes]
        lengths = self.lengths[at]
        values = gather(self.flat, self.starts[at], lengths)
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = np.cumsum(counts)
        return values, before[ends] - before[ends - counts]


def flat_lists(lists: list[list], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Lists behind one another, and their lengths."""
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter((x for one in lists for x in one), dtype=dtype, count=int(lengths.sum())), lengths
