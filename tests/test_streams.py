"""Streams in any micro-batches, with late and repeated rows and restarts, against what a table at once gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lamina.sources.byte_log import ByteLog, boundary
from lamina.streaming import jobs

T0 = 1_700_000_000


def events(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["queue", "start", "start", "finish", "other"])
        out.append((f"j{rng.randrange(40)}", i, T0 + 60 * i + rng.randrange(5), kind, rng.choice([0, 0, 1, 2, None])))
    out += [(None, 1000, T0, "start", 0), ("j1", None, T0, "start", 0), ("solo", 1001, T0 + 30, "finish", 3), ("queued", 1002, T0 + 9, "queue", None)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "job_id string, event_id long, s long, kind string, code int").select("job_id", "event_id", F.timestamp_seconds("s").alias("ts"), "kind", "code")


def run(spark, source, out, check):
    stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    shown = jobs.rows(stream, 900, 100_000)
    shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def seen(df):
    return {r["job_id"]: tuple(r[c] for c in ("status", "created_at", "started_at", "finished_at", "returncode", "error")) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_jobs_in_any_batches(spark, tmp_path, batches):
    rows = events()
    rng = random.Random(batches)
    dealt = rows + rng.sample(rows, 150)  # some come twice
    if batches > 1:
        rng.shuffle(dealt)  # and late
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    half = len(dealt) // 2 if batches > 1 else len(dealt)
    size = -(-len(dealt) // batches)
    for at in range(0, half, size):
        table(spark, dealt[at : at + size]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, check)
    for at in range(-(-half // size) * size, len(dealt), size):  # a restart from the checkpoint
        table(spark, dealt[at : at + size]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, check)
    mark = F.timestamp_seconds(F.lit(max(r[2] for r in rows if r[3] != "other" and r[0] and r[1] is not None) - 100_000))
    assert seen(jobs.latest(spark.read.parquet(out))) == seen(jobs.fold(table(spark, rows), 900, mark))


def test_overdue_jobs_fail_and_late_results_win(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed = lambda *rows: table(spark, list(rows)).coalesce(1).write.mode("append").parquet(source)
    read = lambda: seen(jobs.latest(spark.read.parquet(out)))

    def go():
        stream = spark.readStream.schema(jobs.EVENT).parquet(source)
        jobs.rows(stream, 900, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    feed(("a", 1, T0, "start", None), ("b", 2, T0, "start", None))
    go()
    assert read()["a"][0] == "running"
    feed(("c", 3, T0 + 1600, "start", None))
    go()
    assert read()["a"][0] == read()["b"][0] == "failed" and read()["a"][5] == jobs.OVERDUE
    assert read()["c"][0] == "running"
    feed(("a", 4, T0 + 1200, "finish", 0))
    go()
    assert read()["a"][0] == "succeeded" and read()["a"][5] is None and read()["b"][0] == "failed"


def test_many_jobs_share_few_states(spark, tmp_path):
    """Jobs by the thousand cost a few calls of Python a batch, and each keeps its own versions and its own time to fail."""
    rng = random.Random(7)
    n, slots = 3000, 6
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(f"j{rng.randrange(n)}", i, T0 + 5 * i, rng.choice(["queue", "start", "start", "finish"]), rng.choice([0, 0, 1, None])) for i in range(6000)]
    parts = rows[4000:], rows[:2000] + rows[4500:4800], rows[2000:4000]
    for part in parts:
        table(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.rows(stream, 900, 20_000, slots).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= slots
    shown = spark.read.parquet(out)
    mark = F.timestamp_seconds(F.lit(T0 + 5 * 5999 - 20_000))
    assert seen(jobs.latest(shown)) == seen(jobs.fold(table(spark, rows), 900, mark))
    had = {r["job_id"]: (r["n"], r["top"]) for r in shown.groupBy("job_id").agg(F.count("*").alias("n"), F.max("version").alias("top")).collect()}
    assert all(k == top for k, top in had.values()), "versions count the rows of a job"
    due = {r["job_id"] for r in shown.where(F.col("error") == jobs.OVERDUE).collect()}
    batches = lambda j: sum(any(e[0] == j for e in part) for part in parts)
    assert due and all(had[j][0] <= batches(j) + (j in due) for j in had), "a row only when there is news"


def test_overdue_at_the_very_mark(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for row in (("a", 1, T0, "start", None), ("b", 2, T0 + 1, "start", None), ("c", 3, T0 + 1500, "start", None)):
        table(spark, [row]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(jobs.EVENT).parquet(source)
        jobs.rows(stream, 900, 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {k: v[0] for k, v in seen(jobs.latest(spark.read.parquet(out))).items()} == {"a": "failed", "b": "running", "c": "running"}


def test_merging_knows_no_order():
    rng = random.Random(4)
    for _ in range(50):
        steps = [(rng.randrange(5), i, rng.randrange(3), rng.randrange(2)) for i in range(8)]
        states = []
        for _ in range(4):
            state = {"version": 0, **dict.fromkeys(jobs.FIELDS)}
            for s in rng.sample(steps, 8) + rng.sample(steps, 3):
                jobs.merged(state, *s)
            states.append(state)
        assert all(s == states[0] for s in states)


def collected(spark, folder, out, check, limit):
    spark.dataSource.register(ByteLog)
    stream = spark.readStream.format("byte_log").option("limit", limit).load(folder)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).toPandas().sort_values(["file", "start"])


@pytest.mark.parametrize("limit", [4, 7, 1 << 19])
def test_growing_logs(spark, tmp_path, limit):
    """Appended in stretches that cut characters, every byte comes once and no character is split."""
    folder, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    os.makedirs(f"{folder}/deep")
    text = {"a.log": "añb€c𝒳d\n" * 5, "deep/b.log": "é" * 33}
    data = {k: v.encode() for k, v in text.items()}
    for cut, upto in ((0, 11), (11, 11), (11, 30), (30, 1000)):
        for name, b in data.items():
            with open(f"{folder}/{name}", "ab") as f:
                f.write(b[cut:upto])
        got = collected(spark, folder, out, check, limit)
    for name, t in text.items():
        own = got[got.file == name]
        assert "".join(own.text) == t
        assert own.start.tolist() == [0, *own.end.tolist()[:-1]] and own.end.max() == len(data[name])
        assert (own.end - own.start).max() <= limit


def test_logs_that_shrink_or_are_no_text(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    os.makedirs(folder)
    write = lambda name, b: open(f"{folder}/{name}", "wb").write(b)
    write("a", b"first run, long")
    write("b", b"\x80\x80\x80\x80\xff\xe2\x82")
    write("empty", b"")
    collected(spark, folder, out, check, 100)
    write("a", b"again")
    got = collected(spark, folder, out, check, 100)
    assert sorted(got[got.file == "a"].text) == ["again", "first run, long"]
    assert got[got.file == "b"].end.max() == 5 and set(got.file) == {"a", "b"}


def test_ends_of_characters():
    for c in "aé€𝒳":
        b = c.encode()
        for i in range(1, len(b)):
            assert boundary(b"x" + b[:i]) == i
        assert boundary(b) == 0
    assert boundary(b"") == 0 and boundary(b"\x80\x80\x80\x80") == 0


def test_tasks_read_many_pieces(tmp_path):
    """Tasks grow with bytes, not with pieces; pieces stay small and whole."""
    from lamina.sources.byte_log import Reader

    data = ("añb€c𝒳d\n" * 3000).encode()
    (tmp_path / "a.log").write_bytes(data)
    reader = Reader(str(tmp_path), 64)
    tasks = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(tasks) == 1
    rows = list(reader.read(tasks[0]))
    assert "".join(r[3] for r in rows).encode() == data and max(r[2] - r[1] for r in rows) <= 64
    assert [r[1] for r in rows] == [0, *[r[2] for r in rows[:-1]]]
