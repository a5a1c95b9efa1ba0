"""Near duplicates on word shingles: banded MinHash candidates, odd sketches, exact sets.

Every document gets the set of its distinct word shingles, a MinHash signature,
the keys of its bands, and an odd sketch: the signature folded into a parity
bitmap. Two sketches differ in at most two bits per differing sample, so the
population count of their XOR proves most candidates to be no link; the rest is
decided on the full sets.

Documents with equal sets are one class, and classes are what is compared. In a
first round every band bucket compares its members with one leader, so a large
group of copies costs one pair per copy. Only buckets that still hold several
components go on: members outside the bucket's largest component are held
against all others in cells of bounded size, first by sketch, then, where that
leaves anything, by the full sets. A cell reports one link per member and other
component, never all pairs. Pairs inside a component are not compared again:
they cannot change the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import KEY, arrow_map, byte_slices, hint_small, in_files, key_columns, without_rows, words_in, written
from folioframe.operators.graph import component_links

_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Similarity:
    """Documents are linked when ``den * |A ∩ B| >= num * |A ∪ B|`` over shingles of ``words`` words.

    ``samples`` MinHash values, bands of ``rows`` of them, as many as it takes
    to miss a link at the threshold with a probability below ``miss``; a sketch
    of ``bits`` bits. ``sigmas`` widen the sketch test beyond the expected
    number of differing samples. ``cell`` members of a bucket meet at a time.
    """

    words: int = 3
    num: int = 85
    den: int = 100
    samples: int = 256
    rows: int = 5
    miss: float = 1e-6
    bits: int = 1024
    sigmas: float = 6.5
    cell: int = 512
    seed: int = 20_011

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.num / self.den) ** self.rows))

    @property
    def most_bits(self) -> int:
        """Differing bits of two sketches that a link can have."""
        differ = 1 - self.num / self.den
        return 2 * math.ceil(self.samples * differ + self.sigmas * math.sqrt(self.samples * differ * (1 - differ)))

    def check(self) -> None:
        if self.bands * self.rows > self.samples:
            raise ValueError("more samples are needed for the bands")


class Shingler:
    """Shingle sets, signatures and sketches of texts; one per task."""

    def __init__(self, like: Similarity):
        self.like = like
        random = np.random.default_rng(like.seed)
        odd = lambda n, kind, top: random.integers(0, top, n, dtype=kind) | kind(1)
        self.place = odd(like.words, np.uint64, _MASK)
        self.mix = odd(2, np.uint64, _MASK)
        self.factor, self.shift = odd(like.samples, np.uint32, 2**32 - 1), random.integers(0, 2**32 - 1, like.samples, dtype=np.uint32)
        self.fold = odd(like.samples, np.uint64, _MASK)
        self.band = odd(like.rows, np.uint64, _MASK)

    def _stir(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * self.mix[0]
        x = (x ^ (x >> np.uint64(29))) * self.mix[1]
        return x ^ (x >> np.uint64(32))

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted 64-bit hashes of the distinct shingles of each text; a null text has none."""
        k = self.like.words
        words, codes, counts = words_in(texts)  # A-Z alone are lower-cased, and the six ASCII white spaces cut
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))[codes]
        runs = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
        for i in range(k):
            runs += hashes[i:i + len(runs)] * self.place[i]
        runs = self._stir(runs)
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(runs[at:at + n - k + 1]))
            elif n:  # the whole sequence is the one shingle; its length keeps it apart from full ones
                short = (hashes[at:at + n] * self.place[:n]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(self._stir(np.array([short], dtype=np.uint64) ^ np.uint64(0x5DEECE66D)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
            at += n
        return out

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.like.samples, 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(low, (x[at:at + 256, None] * self.factor + self.shift).min(axis=0), out=low)
        return low

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, bands) keys; the band's number is part of the key."""
        like = self.like
        used = signatures[:, :like.bands * like.rows].astype(np.uint64).reshape(len(signatures), like.bands, like.rows)
        return self._stir((used * self.band).sum(axis=2, dtype=np.uint64) + np.arange(like.bands, dtype=np.uint64) * self.mix[0])

    def sketches(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, bits / 64) parity bitmaps of the samples."""
        n, bits = len(signatures), self.like.bits
        places = ((signatures.astype(np.uint64) + np.uint64(1)) * self.fold) >> np.uint64(64 - int(math.log2(bits)))
        flat = (places.astype(np.int64) + np.arange(n)[:, None] * bits).ravel()
        parity = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
        return np.packbits(parity, axis=1).view(np.int64)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(matrix.ravel().view(np.int64), pa.int64()))


def shingled(rows: DataFrame, like: Similarity) -> DataFrame:
    """Per row: its name, ``id, n`` (set size), ``digest`` of the set, ``bands`` and ``sketch``."""

    def work(batch: pa.RecordBatch):
        tool = Shingler(like)
        for begin, end in byte_slices(batch.column(3), 2_000_000):
            files, places, ids, texts = (batch.column(i).slice(begin, end - begin) for i in range(4))
            sets = tool.sets(texts)
            signatures = np.stack([tool.signature(s) for s in sets])
            # an empty set is like no other, so the name of its row stands for it
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else f"empty {f} {p}".encode()
                       for s, f, p in zip(sets, files.to_pylist(), places.to_pylist())]
            yield {
                KEY[0]: files, KEY[1]: places, "id": ids, "n": [len(s) for s in sets], "digest": digests,
                "bands": _lists(tool.band_keys(signatures)), "sketch": _lists(tool.sketches(signatures)),
            }

    longs = pa.list_(pa.int64())
    return arrow_map(rows, work, f"{KEY[0]} long, {KEY[1]} long, id long, n long, digest binary, bands array<long>, sketch array<long>", pa.schema(
        [*((k, pa.int64()) for k in KEY), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", longs), ("sketch", longs)]))


def _near(a: str, b: str, like: Similarity):
    """The tests that need no set: sizes, then sketches."""
    sizes = F.least(f"{a}.n", f"{b}.n") * like.den >= F.greatest(f"{a}.n", f"{b}.n") * like.num
    bits = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return sizes & (bits <= like.most_bits)


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, like: Similarity) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose full sets are similar enough.

    A class ``a`` with many partners is dealt to groups of bounded size, each of
    which gets its set once; the set of a ``b`` travels once per pair.
    """
    sized = pairs.join(classes.select(F.col("cls").alias("b"), "n"), "b")
    named = classes.select(F.col("cls").alias("row"), *KEY)
    weight = sized.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / 256), F.ceil(F.sum("n") / 2_000_000)).alias("parts"))
    dealt = sized.join(weight, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    wanted = written(dealt.select("a", "part", F.col("b").alias("row")).unionAll(
        dealt.select("a", "part", F.col("a").alias("row")).distinct()).join(named, "row"), "wanted")
    texts = rows.join(hint_small(wanted), KEY).select("a", "part", "row", "text")

    def work(batch: pa.RecordBatch):
        tool = Shingler(like)
        for begin, end in byte_slices(batch.column(3), 2_000_000):
            n = end - begin
            yield {"a": batch.column(0).slice(begin, n), "part": batch.column(1).slice(begin, n), "row": batch.column(2).slice(begin, n),
                   "set": [s.tobytes() for s in tool.sets(batch.column(3).slice(begin, n))]}

    sets = arrow_map(texts, work, "a long, part long, row long, set binary",
                     pa.schema([("a", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("set", pa.binary())]))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        a = group["a"][0].as_py()
        names, sets = group["row"].to_pylist(), [np.frombuffer(s.as_py(), dtype=np.uint64) for s in group["set"]]
        lead = sets[names.index(a)]
        linked = []
        for b, other in zip(names, sets):
            if b == a:
                continue
            at = np.searchsorted(lead, other)
            common = int((lead[np.minimum(at, len(lead) - 1)] == other).sum())
            if like.den * common >= like.num * (len(lead) + len(other) - common):
                linked.append(b)
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())}, schema=schema)

    return sets.groupBy("a", "part").applyInArrow(compare, "a long, b long")


def _cells(open_members: DataFrame, like: Similarity) -> DataFrame:
    """Members ``(band, key, cls, comp)`` of buckets with several components, dealt to cells ``(key, i, j)`` of bounded size.

    Members outside the bucket's largest component ask, in part i; all members
    answer, in part j. Every pair of two components so meets in some cell.
    """
    sizes = open_members.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    main = main.select("key", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("minor"))
    members = open_members.join(main, "key")
    parts = lambda n: F.greatest(F.ceil(F.col(n) / like.cell), F.lit(1))
    deal = lambda n: F.pmod(F.xxhash64("cls"), parts(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    asking = members.where(F.col("comp") != F.col("main")).select(
        "band", "key", "cls", "comp", deal("minor").alias("i"), every("all").alias("j"), F.lit(True).alias("asks"))
    return asking.unionByName(members.select("band", "key", "cls", "comp", every("minor").alias("i"), deal("all").alias("j"), F.lit(False).alias("asks")))


def _near_members(cells: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """Rows of the cells that sketch and size leave as possible ends of a link to another component.

    A pair that shares several buckets is looked at in the first of them.
    """

    def cell(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        comp, n = group["comp"].to_numpy(), group["n"].to_numpy()
        sketch, bands = (pc.list_flatten(group[c].combine_chunks()).to_numpy().reshape(len(n), -1) for c in ("sketch", "bands"))
        sketch, band = sketch.view(np.uint64), group["band"][0].as_py()
        answering, near = np.flatnonzero(~asks), np.zeros(len(n), dtype=bool)
        for at in np.flatnonzero(asks).tolist():
            apart = answering[(comp[answering] != comp[at])
                              & (np.minimum(n[answering], n[at]) * like.den >= np.maximum(n[answering], n[at]) * like.num)]
            apart = apart[np.bitwise_count(sketch[apart] ^ sketch[at]).sum(axis=1) <= like.most_bits]
            apart = apart[(bands[apart] == bands[at]).argmax(axis=1) == band]
            near[apart] = True
            near[at] |= len(apart) > 0
        return group.select(["key", "i", "j", "cls", "comp", "asks"]).filter(pa.array(near))

    full = cells.join(classes.select("cls", "n", "sketch", "bands"), "cls").select("band", "key", "i", "j", "cls", "comp", "asks", "n", "sketch", "bands")
    return full.groupBy("key", "i", "j").applyInArrow(cell, "key long, i long, j long, cls long, comp long, asks boolean")


def _links_between(near: DataFrame, classes: DataFrame, rows: DataFrame, like: Similarity) -> DataFrame:
    """Links ``(a, b)`` between components, decided on the full sets inside the cells: one per asking member and other component, if there is any."""
    wanted = written(near.join(classes.select("cls", *KEY), "cls"), "near")
    texts = rows.join(hint_small(wanted), KEY).select("key", "i", "j", "cls", "comp", "asks", "text")
    fields = [("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64()), ("asks", pa.bool_())]

    def work(batch: pa.RecordBatch):
        tool = Shingler(like)
        for begin, end in byte_slices(batch.column(6), 2_000_000):
            yield {**{name: batch.column(c).slice(begin, end - begin) for c, (name, _) in enumerate(fields)},
                   "set": [s.tobytes() for s in tool.sets(batch.column(6).slice(begin, end - begin))]}

    sets = arrow_map(texts, work, "key long, i long, j long, cls long, comp long, asks boolean, set binary", pa.schema([*fields, ("set", pa.binary())]))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def cell(group: pa.Table) -> pa.Table:
        asks, cls, comp = (group[c].to_numpy() for c in ("asks", "cls", "comp"))
        own = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in group["set"]]
        n = np.array([len(s) for s in own], dtype=np.int64)
        values, places = np.unique(np.concatenate(own), return_inverse=True)
        begins = np.cumsum(n) - n
        answering = np.flatnonzero(~asks)
        shingles = np.concatenate([places[begins[k]:begins[k] + n[k]] for k in answering]) if len(answering) else places[:0]
        heads = np.cumsum(n[answering]) - n[answering]
        marked = np.zeros(len(values), dtype=bool)
        links = set()
        for at in np.flatnonzero(asks).tolist() if len(answering) else []:
            mine = places[begins[at]:begins[at] + n[at]]
            marked[mine] = True
            common = np.add.reduceat(marked[shingles].astype(np.int64), heads)
            marked[mine] = False
            hit = answering[(like.den * common >= like.num * (n[at] + n[answering] - common)) & (comp[answering] != comp[at])]
            for k in np.unique(comp[hit], return_index=True)[1].tolist():
                links.add((min(int(cls[at]), int(cls[hit[k]])), max(int(cls[at]), int(cls[hit[k]]))))
        pairs = sorted(links)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())}, schema=schema)

    return sets.groupBy("key", "i", "j").applyInArrow(cell, "a long, b long").distinct()


def _roots(links: DataFrame) -> DataFrame:
    edges = links.select(F.lit(0).cast("long").alias("page_id"), F.col("a").alias("u"), F.col("b").alias("v"))
    return component_links(edges).select(F.col("u").alias("cls"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept_row`` and the name of the row (``KEY``).

    Words are runs of characters other than space and the control characters 9
    to 13, A-Z lower-cased. A text of fewer words than a shingle is one shingle
    as a whole; null texts and texts without a word have an empty set, are
    linked with nothing, and are components of their own. ``component_id`` is
    the smallest id reachable over links; null ids count only where a component
    has no other. ``kept_row`` holds for one row per component, of the smallest
    id. Rows that repeat belong to one component. Sets are kept as 64-bit
    hashes of shingles.
    """
    like.check()
    rows = in_files(docs).select(*key_columns(), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(shingled(rows, like).withColumn("row", F.monotonically_increasing_id()), "shingled")
    ordered = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = prints.where("n > 0").groupBy("digest").agg(F.min(ordered).alias("least"))
    # a class is named by one of its rows, whose text stands for it
    classes = written(first.join(prints.select("row", *KEY, "n", "bands", "sketch"), first["least.row"] == F.col("row")).select(
        F.col("row").alias("cls"), *KEY, "digest", "least", "n", "bands", "sketch"), "classes")
    members = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    leaders = members.groupBy("key").agg(F.min("cls").alias("a"), F.count("*").alias("m")).where("m > 1")
    buckets = written(members.join(leaders, "key").select("band", "key", "cls", "a"), "buckets")
    slim = classes.select("cls", *KEY, "n", "sketch", "bands")
    star = buckets.where("cls > a").select("a", F.col("cls").alias("b")).distinct()
    side = lambda name: slim.select(F.col("cls").alias(name), F.struct("n", "sketch").alias(f"{name}_"))
    pairs = written(star.join(side("a"), "a").join(side("b"), "b").where(_near("a_", "b_", like)).select("a", "b"), "pairs")
    links = written(confirmed(pairs, slim, rows, like), "links")
    roots = _roots(links)
    named = buckets.join(roots, "cls", "left").select("band", "key", "cls", F.coalesce("root", "cls").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    near = _near_members(_cells(written(named.join(mixed, "key", "left_semi"), "open"), like), slim, like)
    between = written(_links_between(near, slim, rows, like), "links")
    if not between.isEmpty():
        roots = _roots(links.unionByName(between))
    comps = classes.select("cls", "digest", "least").join(roots, "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
    least = comps.groupBy("comp").agg(F.min("least").alias("top"))
    named = written(comps.join(least, "comp").select("digest", "top"), "components")
    return prints.select(*KEY, "row", "id", "n", "digest").join(named, "digest", "left").select(
        *KEY, "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("top.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("row") == F.col("top.row")).otherwise(True).alias("kept_row"))


def drop_near(docs: DataFrame, like: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates; all columns as they were."""
    docs = in_files(docs)
    return without_rows(docs, near_groups(docs, like, id_col, text_col).where("not kept_row"))
