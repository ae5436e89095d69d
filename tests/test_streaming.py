"""Streams against the same operation on a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from glossaria.streaming import state

T = datetime(2024, 1, 1)
SCHEMA = "file string, ts timestamp"


def save(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_debounce_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", T + timedelta(seconds=s)) for s in (0, 2, 4, 30, 33)] + [("b", T + timedelta(seconds=1)), ("z", T + timedelta(hours=1))]
    save(spark, path, rows)
    out = state.debounce(spark.readStream.schema(SCHEMA).parquet(path), "file", late="1 second")
    drain(out.writeStream.format("memory").queryName("bursts").outputMode("append").start())
    streamed = {(r.file, r.n) for r in spark.table("bursts").collect()}
    batch = {(r.file, r.n) for r in state.debounce(spark.read.parquet(path), "file").collect()}
    assert streamed == {("a", 3), ("a", 2), ("b", 1)} and batch == streamed | {("z", 1)}


def test_throttle(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", T + timedelta(seconds=s)) for s in (0, 100, 299, 300, 500, 601)]
    save(spark, path, rows)
    batch = sorted(r.ts for r in state.throttle(spark.read.parquet(path), "file").collect())
    assert batch == [T, T + timedelta(seconds=300), T + timedelta(seconds=601)]
    out = state.throttle_stream(spark.readStream.schema(SCHEMA).parquet(path), "file")
    drain(out.writeStream.format("memory").queryName("fired").outputMode("append").start())
    assert sorted(r.ts for r in spark.table("fired").collect()) == batch


def test_follow(spark, tmp_path):
    schema = "file string, version long, deleted boolean, key string, locale string, value string"
    path, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    save(spark, path, [("f", 1, False, "a", "en", "1"), ("g", 1, False, "b", "en", "2")], schema)
    state.follow(stream(), table, check).awaitTermination()
    save(spark, path, [("f", 2, False, "a", "en", "3"), ("g", 2, True, None, None, None)], schema)
    state.follow(stream(), table, check).awaitTermination()
    assert [(r.file, r.value) for r in spark.read.parquet(f"{table}/1").collect()] == [("f", "3")]


def test_tombstones(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    dead = spark.createDataFrame([("a", T - timedelta(minutes=30)), ("b", T - timedelta(hours=3)), ("c", T - timedelta(days=2))], "key string, deleted_at timestamp")
    assert [r.key for r in state.alive(keys, dead, F.lit(T)).collect()] == ["b"]
    assert {r.key for r in state.purge(dead, F.lit(T)).collect()} == {"a", "b"}


def test_until_stable():
    seen = []
    state.until_stable(lambda s: (seen.append(s) or s + 1, "same"), 0, most=5)
    assert len(seen) == 2


def prompted(times, wait):
    """(at, saves) of one key, in plain Python, until its last timer."""
    out, last, waiting = [], None, 0
    for t in [*sorted(times), 10**9]:
        if waiting and t >= last + wait:
            last += wait
            out.append((last, waiting))
            waiting = 0
        if t == 10**9:
            return out
        if last is None or t >= last + wait:
            last = t
            out.append((t, 1))
        else:
            waiting += 1


def test_prompts_go_on_after_a_restart(spark, tmp_path):
    from glossaria.streaming import keyed

    path, check, table = (str(tmp_path / x) for x in ("in", "check", "out"))
    seconds = {"a": [0, 100, 250, 300, 301, 950], "b": [20], "c": [900, 905]}
    first = [(k, T + timedelta(seconds=s)) for k, ss in seconds.items() for s in ss if s <= 250]
    rest = [(k, T + timedelta(seconds=s)) for k, ss in seconds.items() for s in ss if s > 250]

    def run():
        out = keyed.prompts(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), "file", late="1 second")
        out.writeStream.format("parquet").option("path", table).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    with keyed.rocksdb(spark):
        save(spark, path, first)
        run()
        save(spark, path, rest)
        run()
        save(spark, path, [("z", T + timedelta(hours=5))])
        run()
        save(spark, path, [("z", T + timedelta(hours=15))])
        run()
    got = sorted((r.key, int((r.at - T).total_seconds()), r.saves) for r in spark.read.parquet(table).collect() if r.key != "z")
    assert got == sorted((k, at, n) for k, s in seconds.items() for at, n in prompted(s, 300))
    left = spark.read.format("state-metadata").load(check)
    assert left.count() > 0
    state_rows = spark.read.format("statestore").option("stateVarName", "prompts").load(check).select("key.file").collect()
    assert {r.file for r in state_rows} == {"z"}


def test_tombstones_expire(spark, tmp_path):
    from glossaria.streaming import keyed

    schema = "key string, ts timestamp, deleted boolean, value string"
    path, check, table = (str(tmp_path / x) for x in ("in", "check", "out"))
    at = lambda m: T + timedelta(minutes=m)
    with keyed.rocksdb(spark):
        for rows in ([("a", at(0), True, None), ("b", at(1), False, "b1"), ("a", at(30), False, "early")], [("a", at(61), False, "later"), ("b", at(70), True, None)], [("z", at(60 * 30), False, "z")], [("z", at(60 * 60), False, "z2"), ("b", at(60 * 60), False, "b2")]):
            save(spark, path, rows, schema)
            out = keyed.without_tombstones(spark.readStream.schema(schema).parquet(path), late="1 second")
            out.writeStream.format("parquet").option("path", table).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r.value) for r in spark.read.parquet(table).collect()) == [("a", "later"), ("b", "b1"), ("b", "b2"), ("z", "z"), ("z", "z2")]
    assert spark.read.format("statestore").option("stateVarName", "deleted").load(check).count() == 0


def test_change_log(spark, tmp_path):
    """Batches write their own files only; a repeated batch changes nothing, one that fails leaves nothing, old batches fold into one."""
    from pyspark.sql.types import _parse_datatype_string as parse

    schema = "file string, version long, deleted boolean, key string, value string"
    path, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    kind = parse(schema)
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    now = lambda: sorted((r.file, r.key, r.value) for r in state.latest(spark, table, kind).collect())
    save(spark, path, [("f", 1, False, "a", "1"), ("f", 1, False, "b", "2"), ("g", 1, False, "c", "3")], schema)
    state.log_changes(stream(), table, check).awaitTermination()
    assert now() == [("f", "a", "1"), ("f", "b", "2"), ("g", "c", "3")]
    save(spark, path, [("f", 2, False, "a", "4"), ("f", 1, False, "old", "x"), ("g", 2, True, None, None)], schema)
    state.log_changes(stream(), table, check).awaitTermination()
    after = [("f", "a", "4")]
    assert now() == after and spark.read.parquet(f"{table}/batch=1").where("file = 'f'").count() == 1
    # the last batch again, as after a failure between its write and its commit
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    state.log_changes(stream(), table, check).awaitTermination()
    assert now() == after
    save(spark, path, [("h", 1, False, "d", "5")], schema)
    state.log_changes(stream(), table, check).awaitTermination()
    state.compact(spark, table, kind, 1)
    assert now() == [*after, ("h", "d", "5")] and sorted(p.name for p in (tmp_path / "table").glob("batch=*")) == ["batch=1", "batch=2"]
