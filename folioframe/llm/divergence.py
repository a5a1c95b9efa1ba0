"""Source divergence: exact term vectors per language, group sums, sparse evaluation of pairs.

Per language the terms of at least ``min_df`` documents are kept, however many
they are (the vocabulary size is the largest integer). Every task builds the
sparse term vectors of its documents and sums them per group of language and
source; the sums and document frequencies of all tasks are added by term, since
a vocabulary of that size fits neither a driver nor a broadcast. A term's row so
holds a column of all group vectors, with the groups that have it.

A pair of groups is the sum over all kept terms of a function of two
probabilities. Terms that neither group has all give the same value, terms of
one group alone depend on its count only and are summed over the histogram of
its counts, and only terms of both are evaluated one by one. Pairs of a term are
added up where the term lies; what moves is one sum per pair and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.base import bounded_batches, byte_slices, hint_small, text_bytes, tidy, written

#: Probabilities are integers, in this unit.
UNIT = 1_000_000_000
#: Bytes of text whose vectors are summed at once, and pairs of a term's groups evaluated at once.
SLICE_BYTES = 16_000_000
PAIRS = 1_000_000
#: Parts a group's terms are dealt to before its best are taken.
SALTS = 16
#: What a byte of text is to terms: letters in lower case, bytes of other characters as they are, a space for the rest.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The strings with every byte replaced by ``table``, which keeps bytes above 127; nulls become empty."""
    offsets, data = text_bytes(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data.translate(table)))


def term_vectors(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of documents: the distinct terms, and per entry its document, the number of its term, and the count.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.
    Entries are sorted by document and term.
    """
    parts = pc.ascii_split_whitespace(translated(texts, _TERM_BYTES))
    coded = parts.flatten().dictionary_encode()
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    terms, width = coded.dictionary, max(1, len(coded.dictionary))
    entries, counts = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64) * width, sizes) + coded.indices.to_numpy(), return_counts=True)
    document, code = entries // width, (entries % width).astype(np.int32)
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()  # in front of and behind white space
    if empty >= 0:
        full = code != empty
        document, code, counts = document[full], code[full], counts[full]
    return terms, document, code, counts


def group_sums(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` of ``docs`` (lang, source, text): the sums of the document vectors of each group."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in byte_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                terms, document, code, counts = term_vectors(part.column(2))
                langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                key = group[document] * max(1, len(terms)) + code
                order = np.argsort(key, kind="stable")
                key = key[order]
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
                of, term = np.divmod(key[heads], max(1, len(terms)))
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(of // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(of % max(1, len(sources.dictionary)))),
                    terms.take(pa.array(term)), pa.array(np.add.reduceat(counts[order], heads) if len(heads) else counts, pa.int64()),
                    pa.array(np.diff(np.append(heads, len(key))), pa.int64())], schema=schema)

    bounded_batches(docs.sparkSession)
    summed = docs.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, term string, n long, df long")
    return summed.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + kept))``, exact for any counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(UNIT)) * (wide(count) + wide(F.lit(1))), wide(total) + wide(kept))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _common_terms(entries: DataFrame) -> DataFrame:
    """Of ``entries`` (t, g, p, zero), rows of a term behind one another: what common terms add to pairs ``a, b`` of groups.

    ``p`` is a group's probability of the term, ``zero`` that of a term it has
    not. Terms of both groups were counted as terms of either alone before, so
    that is taken back.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def evaluate(t: np.ndarray, g: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole terms only."""
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.append(heads, len(t)))
        first, width = np.repeat(heads, sizes), np.repeat(sizes, sizes)  # of the term of each entry
        steps = np.cumsum(width) // PAIRS
        for rows in np.split(np.arange(len(t)), np.flatnonzero(np.diff(steps)) + 1):
            w = width[rows]
            i = np.repeat(rows, w)
            j = np.repeat(first[rows] - (np.cumsum(w) - w), w) + np.arange(len(i))
            i, j = i[i != j], j[i != j]
            if len(i):
                value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
                order = np.lexsort([g[j], g[i]])
                a, b = g[i][order], g[j][order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.add.reduceat(value[order], new))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            rest = [np.concatenate([old, c.to_numpy()]) for old, c in zip(rest, batch.columns)]
            if len(rest[0]):
                done = int(np.searchsorted(-(rest[0][::-1] == rest[0][-1]).astype(int), 0))  # rows of the last term, which may go on
                cut = len(rest[0]) - done
                if cut:
                    yield from evaluate(*(c[:cut] for c in rest))
                rest = [c[cut:] for c in rest]
        if len(rest[0]):
            yield from evaluate(*rest)

    return entries.select("t", "g", "p", "zero").mapInArrow(tidy(run), "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("both"))


def source_divergence(docs: DataFrame, min_df: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language are from each other and from the whole.

    Part ``pair`` holds every other source of the language with the divergence
    from it, summed over all kept terms; part ``term`` the ``top`` terms that
    are more frequent in the group than in its language. Ranks begin at 1, by
    falling value, ties by item in byte order.

    Null texts, languages and sources count as empty strings; a group without
    terms, or a language that keeps none, still has its pairs (of value 0 in the
    latter case). Texts are read whole; rows that repeat are documents of their
    own; an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    # one row per kept term: the groups that have it; their number is that of the sources of a language
    sums = group_sums(rows).groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("has"))
    kept = written(sums.where(F.col("df") >= min_df).select(F.monotonically_increasing_id().alias("t"), "lang", "term", "all", "has"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    entries = kept.select("t", "lang", "term", "all", F.explode("has").alias("h")).select("t", "lang", "term", "all", "h.source", "h.n")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_n")))
    safe = lambda p: F.when(F.col("v") > 0, p)
    groups = written(named.select(F.monotonically_increasing_id().alias("g"), "*", safe(probability(F.lit(0), F.col("total"), F.col("v"))).alias("zero")), "groups")
    sized = entries.join(hint_small(groups.select("g", "lang", "source", "total", "v", "lang_n", "zero")), ["lang", "source"])
    sized = sized.withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))
    sized = written(sized.select("t", "g", "p", "zero", "term", probability(F.col("all"), F.col("lang_n"), F.col("v")).alias("q")), "entries")

    # pairs: terms of neither group, of one alone by the histogram of its counts, and of both
    both = _common_terms(sized.repartition("t").sortWithinPartitions("t"))
    counts = sized.groupBy("g", "p").agg(F.count("*").alias("m")).groupBy("g").agg(
        F.collect_list(F.struct("p", "m")).alias("counts"), F.sum("m").alias("terms"))
    side = groups.join(counts, "g", "left")
    a = side.select(F.col("g").alias("a"), "lang", "source", "v", F.col("zero").alias("a_zero"), F.col("counts").alias("a_counts"), F.coalesce("terms", F.lit(0)).alias("a_terms"))
    b = side.select(F.col("g").alias("b"), "lang", F.col("source").alias("item"), F.col("zero").alias("b_zero"), F.col("counts").alias("b_counts"), F.coalesce("terms", F.lit(0)).alias("b_terms"))
    alone = lambda counts, f: F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x["m"] * f(x["p"])), F.lit(0))
    value = ((F.col("v") - F.col("a_terms") - F.col("b_terms")) * divergence(F.col("a_zero"), F.col("b_zero"))
             + alone("a_counts", lambda p: divergence(p, F.col("b_zero"))) + alone("b_counts", lambda p: divergence(F.col("a_zero"), p)) + F.coalesce("both", F.lit(0)))
    pairs = a.join(b, "lang").where("a <> b").join(both, ["a", "b"], "left").select(
        "a", "lang", "source", "item", F.when(F.col("v") > 0, value).otherwise(0).cast("long").alias("value"))
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place(["a"]).alias("rank"))

    more = sized.where("p > q").select("g", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"), F.pmod(F.col("t"), F.lit(SALTS)).alias("salt"))
    best = more.withColumn("rank", place(["g", "salt"])).where(F.col("rank") <= top).drop("rank", "salt")
    best = best.withColumn("rank", place(["g"])).where(F.col("rank") <= top)
    terms = best.join(hint_small(groups.select("g", "lang", "source")), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionAll(terms)
