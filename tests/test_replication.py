import json
import random

from pyspark.sql import functions as F

from codexloom.operators import replication as r
from codexloom.streaming import replication as stream

SHAPE = "key string, value string, millis long, counter long, device string"


def ops(n, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randint(0, 9)}", rng.choice(["", "a", "b", "c"]), rng.randint(0, 5), rng.randint(0, 3), rng.choice("xyz")) for _ in range(n)]


def expected(rows):
    out = {}
    for k, v, m, c, d in rows:
        out[k] = max(out.get(k, ()), (m, c, d, v))
    return out


def as_dict(df):
    return {x["key"]: (x["millis"], x["counter"], x["device"], x["value"]) for x in df.collect()}


def test_merge_is_commutative_associative_idempotent(spark):
    for seed in range(3):
        rows = ops(60, seed)
        a, b = spark.createDataFrame(rows[:30], SHAPE), spark.createDataFrame(rows[30:], SHAPE)
        once = as_dict(r.applied(r.merged(a), b))
        assert once == as_dict(r.applied(r.merged(b), a)) == as_dict(r.applied(r.merged(a.union(b)), b)) == expected(rows)


def test_changes_are_strictly_newer(spark):
    state = spark.createDataFrame([("a", "1", 5, 0, "x"), ("b", "1", 5, 0, "x")], SHAPE)
    new = spark.createDataFrame([("a", "2", 5, 0, "x"), ("b", "2", 5, 1, "a"), ("c", "3", 1, 0, "x")], SHAPE)
    assert sorted(x["key"] for x in r.changes(state, new).collect()) == ["b", "c"]


def test_malformed_lines_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    good = [{"k": "a", "v": "1", "t": [1, 0], "d": "x"}, {"k": "a", "v": "2", "t": [2, 0], "d": "x", "more": 1}, {"k": "b", "v": "", "t": [1, 1], "d": "y"}]
    bad = ["nonsense", '{"k":"a"}', '{"k":"a","v":"9","t":[9],"d":"x"}', '{"k":"a","v":"9","t":"x","d":"x"}']
    (log / "x.jsonl").write_text("\n".join([*map(json.dumps, good), *bad]))
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    assert stream.state_of(spark, table).count() == 0
    stream.run_available(stream.folded(stream.read_log(spark, str(log))), table, state)
    assert as_dict(stream.state_of(spark, table)) == {"a": (2, 0, "x", "2"), "b": (1, 1, "y", "")}
    assert [x["key"] for x in r.live(stream.state_of(spark, table)).collect()] == ["a"]
    stream.append_ops(spark.createDataFrame([("b", "now", [3, 0], "z"), ("a", "old", [1, 5], "z")], "k string, v string, t array<long>, d string"), str(log), "z")
    stream.run_available(stream.folded(stream.read_log(spark, str(log))), table, state)
    assert as_dict(stream.state_of(spark, table)) == {"a": (2, 0, "x", "2"), "b": (3, 0, "z", "now")}


def test_pull_writes_changes_and_the_merged_state(spark):
    have, got = spark.createDataFrame([("a", "1", 5, 0, "x")], SHAPE), []
    step = stream.pull(lambda: have, lambda changed, state: got.append((as_dict(changed), as_dict(state))))
    step(spark.createDataFrame([("a", "0", 4, 0, "y"), ("c", "3", 1, 0, "y")], SHAPE), 0)
    assert got == [({"c": (1, 0, "y", "3")}, {"a": (5, 0, "x", "1"), "c": (1, 0, "y", "3")})]


def test_cycle_reports_and_goes_on():
    done = []
    failed = stream.pull_cycle(lambda: done.append(1), lambda: 1 / 0, lambda: done.append(3), lambda: done.append(4))
    assert done == [1, 3, 4] and [f.split(":")[0] for f in failed] == ["fetch"]


def test_writing_ticks_on_from_the_state(spark):
    state = spark.createDataFrame([("a", "1", 50, 3, "x"), ("b", "1", 20, 9, "y")], SHAPE)
    puts = spark.createDataFrame([(1, "a", "p", 40), (2, "c", "q", 40), (3, "a", "r", 60), (4, "a", "s", 60)], "seq int, key string, value string, now long")
    new, lines = r.written(state, puts, "d")
    assert sorted((x["k"], x["v"], tuple(x["t"]), x["d"]) for x in lines.collect()) == [("a", "p", (50, 4), "d"), ("a", "r", (60, 0), "d"), ("a", "s", (60, 1), "d"), ("c", "q", (50, 5), "d")]
    assert as_dict(new) == {"a": (60, 1, "d", "s"), "b": (20, 9, "y", "1"), "c": (50, 5, "d", "q")}
    assert as_dict(r.written(state.limit(0), puts.limit(1), "d")[0]) == {"a": (40, 0, "d", "p")}
    assert tuple(r.latest(state).first()) == (50, 3) and tuple(r.latest(state.limit(0)).first()) == (None, None)
    assert not r.needs_compaction(state, "x", 1) and r.needs_compaction(state, "x", 0)
    clock = spark.sql("SELECT struct(5L AS millis, 2L AS counter) AS c, struct(5L AS millis, 7L AS counter) AS s")
    row = clock.select(r.received(clock.c, clock.s).alias("r"), r.ticked(clock.c, F.lit(4)).alias("t"), r.ticked(clock.c, F.lit(6)).alias("u")).first()
    assert [tuple(x) for x in row] == [(5, 7), (5, 3), (6, 0)]
