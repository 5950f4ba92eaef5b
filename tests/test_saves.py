"""Debounced saves, serialised writes and polled statuses as streams."""

import json
import time


from furrow.streaming import saves


def wait(until, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if until():
            return True
        time.sleep(0.3)
    return False


def test_a_burst_gives_one_write(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    (tmp_path / "in").mkdir()
    out = tmp_path / "out"
    out.mkdir()
    put = lambda name, rows: (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("key", "seq", "body"), r, strict=True))) for r in rows))

    def write(key, body):
        if key == "bad" and body == "first":
            raise OSError("no room")
        with open(f"{out}/{key}", "a") as f:
            f.write(body + "\n")

    edits = spark.readStream.schema("key string, seq long, body string").json(str(tmp_path / "in"))
    query = saves.save_stream(edits, write, str(tmp_path / "told"), str(tmp_path / "check"), wait_ms=1500)
    try:
        put("one", [("a", 1, "x"), ("a", 3, "last"), ("a", 2, "y"), ("bad", 1, "first"), ("b", 1, "only")])
        told = lambda: sorted(tuple(r) for r in spark.read.schema("key string, seq long, error string").parquet(str(tmp_path / "told")).collect()) if list((tmp_path / "told").glob("*.parquet")) else []
        assert wait(lambda: len(told()) >= 3), query.exception()
        put("two", [("bad", 2, "second")])
        assert wait(lambda: len(told()) >= 4), query.exception()
        assert told() == [("a", 3, None), ("b", 1, None), ("bad", 1, "OSError: no room"), ("bad", 2, None)]
        assert {p.name: p.read_text() for p in out.iterdir()} == {"a": "last\n", "b": "only\n", "bad": "second\n"}
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def test_writes_of_a_key_go_one_after_the_other(spark, tmp_path):
    rows = [(k, s, str(s)) for k in ("p", "q") for s in (3, 1, 2, 5, 4)]

    def write(key, body):
        if body == "2":
            raise ValueError("refused")
        with open(f"{tmp_path}/{key}", "a") as f:
            f.write(body)

    got = saves.serial_writes(spark.createDataFrame(rows, "key string, seq long, body string").repartition(4), write).collect()
    assert {(r.key, r.seq) for r in got if r.error} == {("p", 2), ("q", 2)} and len(got) == 10
    assert (tmp_path / "p").read_text() == (tmp_path / "q").read_text() == "1345"


def test_statuses_are_polled_until_they_end(spark, tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    put = lambda task, status, progress: (folder / f"{task}.json").write_text(json.dumps({"task_id": task, "status": status, "progress": progress}))
    put("t1", "queued", 0)
    put("t2", "completed", 100)
    (folder / "half.json").write_text("{")

    def start():
        stream = saves.polled_statuses(spark, str(folder))
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

    told = lambda: sorted((r.task_id, r.status, r.progress) for r in spark.read.schema("task_id string, status string, progress int, poll long").parquet(str(tmp_path / "out")).collect()) if list((tmp_path / "out").glob("*.parquet")) else []
    query = start()
    try:
        assert wait(lambda: len(told()) >= 2), query.exception()
        put("t1", "running", 40)
        assert wait(lambda: len(told()) >= 3), query.exception()
    finally:
        query.stop()
    put("t1", "completed", 100)
    put("t2", "running", 5)  # ended before: not polled any more
    query = start()
    try:
        assert wait(lambda: len(told()) >= 4), query.exception()
        put("t1", "failed", 1)
        time.sleep(3)
    finally:
        query.stop()
    assert told() == [("t1", "completed", 100), ("t1", "queued", 0), ("t1", "running", 40), ("t2", "completed", 100)]


def test_a_poll_that_sees_nothing_new_keeps_its_offset(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"task_id": "a", "status": "running"}))
    reader = saves.StatusPoll({"path": str(tmp_path)})
    rows, first = reader.read(reader.initialOffset())
    assert list(rows) == [("a", "running", 0, 1)]
    rows, second = reader.read(first)
    assert list(rows) == [] and second == first
    assert list(reader.readBetweenOffsets(reader.initialOffset(), first)) == [("a", "running", 0, 1)]
    assert saves.DEBOUNCE_MS == 700 and saves.POLL_S == 5
