import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from termloom.errors import Backpressure, Invalid, NotFound
from termloom.functions.validate import check_tenant, check_term, split_valid
from termloom.operators import dictionary
from termloom.plans import api
from termloom.plans.engine import Engine
from termloom.plans.store import Store
from termloom.schema import OP_LOG, Config
from termloom.sources import terms
from termloom.streaming import ingest


def replay(log):
    state, totals, rejected = {}, {}, []
    for seq, tenant, term, op, weight in sorted(log):
        key = tenant, term
        if op == "delete":
            if state.pop(key, None) is None:
                rejected.append(seq)
            totals[seq] = None
        else:
            state[key] = weight + (state.get(key, 0) if op == "index" else 0)
            totals[seq] = state[key]
    return state, totals, rejected


def random_log(seed, n=300):
    rng = random.Random(seed)
    return [(i * 3, rng.choice("xy"), rng.choice("abcdé"), rng.choice(["index", "index", "set", "delete"]), rng.randint(0, 5)) for i in range(n)]


def test_fold_equals_replay(spark):
    log = random_log(1)
    frame = spark.createDataFrame(log, OP_LOG)
    state, totals, rejected = replay(log)
    assert {(r["tenant"], r["term"]): r["frequency"] for r in dictionary.fold_ops(frame).collect()} == state
    for block in (16, 65_536):
        assert {r["seq"]: r["total"] for r in dictionary.running_totals(frame, block).collect()} == totals
        assert sorted(r["seq"] for r in dictionary.rejected_deletes(frame, block).collect()) == rejected
    assert dictionary.fold_ops(spark.createDataFrame([], OP_LOG)).count() == 0


def test_validation(spark):
    for bad in ("", "a/b", "a b", "a\0b", "a\nb", "a b"):
        with pytest.raises(Invalid):
            check_tenant(bad)
    check_tenant("acme-1_2")
    check_term("two words")
    for bad in ("", "a\0b"):
        with pytest.raises(Invalid):
            check_term(bad)
    rows = spark.createDataFrame([("ok", "t", 1), ("a b", "t", 1), ("ok", "", 1), (None, "t", 1)], "tenant string, term string, weight bigint")
    good, bad = split_valid(rows)
    assert good.count() == 1 and {r["status"] for r in bad.collect()} == {400} and bad.count() == 3


def test_engine_lifecycle(spark, tmp_path):
    config = Config(data_dir=str(tmp_path), max_batch=3)
    e = Engine.open(spark, config)
    assert e.index("acme", "cat", 5) == 5
    assert e.index("acme", "cat", 3) == 8
    e.index("acme", "car", 9)
    e.index("other", "zebra")
    assert [tuple(r) for r in e.query("acme", "ca", 2).collect()] == [("car", 9), ("cat", 8)]
    assert e.query("nobody", "").count() == 0
    e.delete("acme", "car")
    with pytest.raises(NotFound):
        e.delete("acme", "car")
    e.delete("other", "zebra")
    assert [tuple(r) for r in e.stats().collect()] == [("acme", 1, 1, 3), ("other", 0, 0, 0)] and e.tenant_count() == 2
    e.compact()
    e.index("acme", "cab", 0)
    e.shutdown()
    again = Engine.open(spark, config)
    assert {r["term"]: r["frequency"] for r in again.dictionary().collect()} == {"cat": 8, "cab": 0}
    assert again.tenant_count() == 1 and again.index("acme", "cat", 2) == 10
    good, bad = again.index_batch(spark.createDataFrame([("acme", "dog", 4), ("a/b", "x", 1)], "tenant string, term string, weight bigint"))
    assert good.count() == 1 and bad.count() == 1 and again.frequency("acme", "dog") == 4


def test_api(spark, tmp_path, monkeypatch):
    e = Engine.open(spark, Config(data_dir=str(tmp_path)))
    monkeypatch.setattr(api.handle, "__defaults__", ("", 120.0))  # a first job may take long
    assert api.handle(e, "POST", "/v1/acme/index", json.dumps({"term": "card", "weight": 7}))[0] == 202
    assert api.handle(e, "POST", "/v1/acme/index", json.dumps({"term": "cart"}))[0] == 202
    status, text = api.handle(e, "GET", "/v1/acme/query?prefix=ca&k=1000")
    assert status == 200 and json.loads(text) == [{"term": "card", "score": 7}, {"term": "cart", "score": 1}]
    status, text = api.handle(e, "GET", "/v1/acme/query?prefix=carx&typo=1&k=1")
    assert json.loads(text) == [{"term": "card", "score": 7, "distance": 1}]
    assert api.handle(e, "GET", "/v1/acme/query?prefix=ca&typo=3")[0] == 400
    assert api.handle(e, "POST", "/v1/a%20b/index", '{"term": "x"}')[0] == 400
    assert api.handle(e, "DELETE", "/v1/acme/term/card")[0] == 204
    assert api.handle(e, "DELETE", "/v1/acme/term/card")[0] == 404
    assert json.loads(api.handle(e, "GET", "/health")[1]) == {"status": "ok", "tenants": [{"tenant": "acme", "nodes": 1, "terms": 1, "bytes": 4}]}
    assert api.handle(e, "GET", "/nothing")[0] == 404


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(2, 200)
    frame = spark.createDataFrame(log, OP_LOG)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        ops = ingest.read_ops(spark, str(tmp_path / "in"), Config(max_batch=1))
        ingest.write_ops(ops, store, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert {(r["tenant"], r["term"]): r["frequency"] for r in store.dictionary().collect()} == replay(log)[0]


def test_store_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_batch([])
    store.write_batch([("t", "a", 1), ("t", "b", 2), ("t", "a", None)])
    store.put("t", "c", 3)
    store.delete("t", "b")
    assert [(r["term"], r["frequency"]) for r in store.dictionary().collect()] == [("c", 3)]
    assert store.get("t", "c").first()["frequency"] == 3 and store.get("t", "a").first() is None


def test_config():
    c = Config.from_env({"TERMLOOM_MAX_BATCH": "0", "TERMLOOM_DATA_DIR": "/d"})
    assert (c.max_batch, c.flush_interval_ms, c.data_dir) == (1, 50, "/d")
    for name, text in (("BIND_ADDR", "nonsense"), ("FLUSH_INTERVAL_MS", "x"), ("MAX_BATCH", ""), ("CHANNEL_CAPACITY", "-1")):
        with pytest.raises(Invalid):
            Config.from_env({f"TERMLOOM_{name}": text})


def dictionary_of(store):
    return {(r["tenant"], r["term"]): r["frequency"] for r in store.dictionary().collect()}


def test_compaction_keeps_late_and_concurrent_operations(spark, tmp_path):
    log = random_log(4, 120)
    frame = spark.createDataFrame(log, OP_LOG)
    store = Store(spark, str(tmp_path))
    store.append(frame.where("seq >= 180"))
    store.compact()
    # each late key's first folded operation is a reset, so lateness has an exact answer
    first = {}
    for seq, tenant, term, op, _ in log:
        if seq >= 180:
            first.setdefault((tenant, term), op)
    late = frame.where("seq < 180 and op = 'index'")
    store.append(late)
    kept = [r for r in log if r[0] >= 180 or r[3] == "index"]
    assert dictionary_of(store) == replay(kept)[0]
    assert {r["term"] for r in store.rejected().collect()} == set()
    # a batch that is written while a compaction runs is neither lost nor counted twice
    pending = store._pending_batches(store.current())
    append = store._point

    def meanwhile(version, state):
        store.append(spark.createDataFrame([(10_000, "new", "term", "index", 7)], OP_LOG))
        append(version, state)

    store._point = meanwhile
    store.compact()
    store._point = append
    assert pending and dictionary_of(store) == replay(kept)[0] | {("new", "term"): 7}
    for _ in range(3):
        store.compact()
    assert dictionary_of(store) == replay(kept)[0] | {("new", "term"): 7} and store.next_seq() == 10_001
    assert len(store._names("snapshot")) <= 2 and store._names("log") == []


def test_stream_batch_is_not_folded_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ops = spark.createDataFrame([(0, "t", "a", "index", 5)], OP_LOG)
    store.append(ops, "stream-0")
    for _ in range(3):
        store.compact()
        store.append(ops, "stream-0")  # the stream repeats its batch after a failure
        assert dictionary_of(store) == {("t", "a"): 5}


def test_two_engines_on_one_store(spark, tmp_path):
    one, two = (Engine.open(spark, Config(data_dir=str(tmp_path))) for _ in range(2))
    one.index("t", "a", 1)
    two.index("t", "b", 2)
    one.flush()
    two.flush()
    assert dictionary_of(one.store) == {("t", "a"): 1, ("t", "b"): 2}


def test_writers_and_readers_at_once(spark, tmp_path):
    e = Engine.open(spark, Config(data_dir=str(tmp_path), max_batch=100, channel_capacity=150))
    failed = []

    def write(n):
        try:
            for i in range(100):
                e.submit("t", f"term{n}x{i}", "index", n + 1)
        except Exception as x:
            failed.append(x)

    def read():
        try:
            for _ in range(2):
                assert all(r["frequency"] == int(r["term"][4:].split("x")[0]) + 1 for r in e.dictionary().collect())
        except Exception as x:
            failed.append(x)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(8)] + [threading.Thread(target=read) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    e.shutdown()
    assert not failed
    assert dictionary_of(Store(spark, str(tmp_path))) == {("t", f"term{n}x{i}"): n + 1 for n in range(8) for i in range(100)}


def test_queue(spark, tmp_path):
    e = Engine.open(spark, Config(data_dir=str(tmp_path), max_batch=10, channel_capacity=2, flush_interval_ms=600_000))
    e.try_submit("t", "a", "index", 1)
    e.try_submit("t", "b", "index", 1)
    with pytest.raises(Backpressure):
        e.try_submit("t", "c", "index", 1)
    e.shutdown()
    with pytest.raises(Backpressure):
        e.index("t", "c")
    timed = Engine.open(spark, Config(data_dir=str(tmp_path / "timed"), flush_interval_ms=20))
    timed.submit("t", "a", "index", 3)
    for _ in range(200):
        if dictionary_of(timed.store):
            break
        time.sleep(0.1)
    assert dictionary_of(timed.store) == {("t", "a"): 3}


def test_apply_validates(spark, tmp_path):
    e = Engine.open(spark, Config(data_dir=str(tmp_path)))
    e.index("t", "a", 4)
    log = [(0, "t", "a", "delete", None), (1, "t", "a", "delete", None), (2, "x y", "b", "index", 1), (3, "t", "b", "grow", 1), (4, "t", "c", "set", 6)]
    rejects = {(r["seq"], r["error"] == "no such term") for r in e.apply(spark.createDataFrame(log, OP_LOG)).collect()}
    assert rejects == {(1, True), (2, False), (3, False)}
    assert {(r["term"], r["frequency"]) for r in e.dictionary().collect()} == {("c", 6)}
    e.index("t", "c", 1)
    assert e.frequency("t", "c") == 7


def test_batches_of_requests_on_an_engine(spark, tmp_path):
    e = Engine.open(spark, Config(data_dir=str(tmp_path)))
    seen = spark.createDataFrame([("t", "card", 3), ("t", "cart", 5), ("t", "dog", 1)], "tenant string, term string, weight int")
    good, bad = e.index_batch(seen.where(F.rand() >= 0))
    assert good.count() == 3 and bad.count() == 0
    asked = spark.createDataFrame([(1, "t", "car", 1, 0), (2, "t", "cark", 5, 1)], "query_id bigint, tenant string, query string, k int, typo int")
    assert [tuple(r) for r in e.query_batch(asked).collect()] == [(1, 1, "cart", 5)]
    got = {tuple(r) for r in e.query_fuzzy_batch(asked.where("typo = 1")).collect()}
    assert got == {(2, 1, "cart", 5, 1), (2, 2, "card", 3, 1)}


def test_request_timeout(spark, tmp_path):
    e = Engine.open(spark, Config(data_dir=str(tmp_path)))
    e.stats = lambda: time.sleep(5)
    assert api.handle(e, "GET", "/health", timeout_s=0.1) == (408, "")


def test_json_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"tenant": "t", "term": "a", "weight": 2}', '{"tenant": "t", "term": "a"}', '{"tenant": "x y", "term": "a"}', "nonsense"]
    (tmp_path / "in" / "calls.json").write_text("\n".join(lines))
    store = Store(spark, str(tmp_path / "store"))
    ops = ingest.read_json_ops(spark, str(tmp_path / "in"))
    ingest.write_ops(ops, store, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert dictionary_of(store) == {("t", "a"): 3}
    assert store.rejected().count() == 2
    assert terms.json_input(spark.createDataFrame([(x,) for x in lines[:2]], "value string")).agg(F.sum("weight")).first()[0] == 3


def test_running_tables(spark, tmp_path):
    log = random_log(9, 150)
    for k in range(3):
        spark.createDataFrame(log[50 * k : 50 * k + 50], OP_LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))

    def last(make, name):
        seen = {}

        def take(batch, _):
            seen.update({(r["tenant"], r["term"]): r["frequency"] for r in batch.collect()})

        ops = ingest.read_ops(spark, str(tmp_path / "in" / "part*"), Config(max_batch=1))
        writer = make(ops).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / name))
        writer.trigger(availableNow=True).start().awaitTermination()
        return seen

    state = replay(log)[0]
    assert {k: v for k, v in last(ingest.running_dictionary, "a").items() if v is not None} == state
    sums = {}
    for _, tenant, term, op, weight in log:
        if op == "index":
            sums[tenant, term] = sums.get((tenant, term), 0) + weight
    assert last(ingest.running_frequencies, "b") == sums
