"""Real files on disk."""

import random
import struct

from folioframe.sources import pages as P
from folioframe.sources import tables as S
from folioframe.streaming import jobs as ST


def test_listing_and_pending(spark, tmp_path):
    for name in ("a/1.png", "a/2.JPG", "a/.3.png", "b/4.txt", "b/5.webp", "b/5.html", "b/_6.png", "_c/d/7.png", ".e/8.png"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    files = P.listing(spark, str(tmp_path))
    root = f"file:{tmp_path}/"
    pages = P.page_files(files, root)
    assert {r.rel_path for r in pages.collect()} == {"a/1.png", "a/2.JPG", "b/5.webp", "b/_6.png", "_c/d/7.png"}
    left = P.pending(pages, P.results(files), "html")
    assert {r.rel_path for r in left.collect()} == {"a/1.png", "a/2.JPG", "b/_6.png", "_c/d/7.png"}
    assert P.pending(pages, files, "html", overwrite=True).count() == 5
    assert P.expand_inputs(files, files).count() == 7  # hidden files are not listed
    one = P.listing(spark, f"file:{tmp_path}/a/1.png", str(tmp_path / "a")).collect()
    assert sorted((r.path, r.length) for r in one) == [(f"file:{tmp_path}/a/1.png", 1), (f"file:{tmp_path}/a/2.JPG", 1)]


def test_raw_raster(spark, tmp_path):
    (tmp_path / "m.raw").write_bytes(struct.pack("<HHB", 300, 2, 1) + bytes(i % 256 for i in range(600)))
    df = P.read_raw(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = {(r["y"], r["x"]): r["values"][0] for r in df.select("y", "x", "values").collect()}
    assert len(rows) == 600 and rows[1, 5] == (300 + 5) % 256


def test_text_tables(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("foo bar\n# x\nbaz\n")
    (tmp_path / "vocab.txt").write_text("<S>\n</S>\na\n\nb\n")
    rules, _ = S.read_dictionary(spark, str(tmp_path / "dict.txt"))
    assert {(r.line_no, r.pattern, r.value) for r in rules.collect()} == {(1, "foo", "bar"), (3, "baz", "")}
    vocab = {r.token: r.piece for r in S.read_vocabulary(spark, str(tmp_path / "vocab.txt")).collect()}
    assert vocab == {0: "<S>", 1: "</S>", 2: "a", 3: "", 4: "b"}


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(5).write.mode("append").parquet(src)
    run = lambda: ST.ingest(ST.file_stream(spark, src, spark.range(1).schema), lambda b: b.select("id"), out, state).awaitTermination()
    run()
    spark.range(5, 9).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == list(range(9))


def test_progress_of_many_batches(spark, tmp_path):
    """Equal answers however the files fall into batches, and few runs to read after many."""
    rng = random.Random(9)
    rows = [(i % 3, f"p{rng.randrange(20)}", rng.choice(["running", "done", "failed"]), i) for i in range(400)]
    rng.shuffle(rows)
    src = str(tmp_path / "events")
    spark.createDataFrame(rows, "job_id long, path string, status string, seq long").repartition(23).write.parquet(src)
    schema = spark.read.parquet(src).schema
    answers = []
    for files in (1, 50):
        out = str(tmp_path / f"out{files}")
        ST.follow_progress(ST.file_stream(spark, src, schema, max_files=files), out, str(tmp_path / f"state{files}")).awaitTermination()
        assert len(ST._runs(spark, out)) <= 9 and len(ST._parts(max(ST._runs(spark, out)))) <= 5
        answers.append(sorted(map(tuple, ST.job_progress(ST.progress_states(spark, out)).collect())))
    last = {}
    for job, path, status, seq in rows:
        last[job, path] = max(last.get((job, path), (-1, "")), (seq, status))
    total = {job: [s for (j, _), (_, s) in last.items() if j == job] for job in range(3)}
    assert answers[0] == answers[1] and [(r[0], r[1], r[2]) for r in answers[0]] == [(j, len(s), sum(x != "running" for x in s)) for j, s in total.items()]
