import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import bytestr
from termloom.operators import completions, dictionary, search, shape


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def terms(spark, **weights):
    return spark.createDataFrame([("t", k, v) for k, v in weights.items()], "tenant string, term string, frequency bigint")


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def bulk(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    model = {w: rng.randint(0, 9) for w in words}
    frame = spark.createDataFrame([("t", k, v) for k, v in model.items()], "tenant string, term string, frequency bigint").cache()
    return model, frame


def test_prefix_order_and_limits(spark):
    d = terms(spark, cat=1, car=10, cab=5, dog=100)
    assert rows(search.prefix_topk(d, "t", "ca", 3)) == [("car", 10), ("cab", 5), ("cat", 1)]
    assert rows(search.prefix_topk(d, "t", "ca", 2)) == [("car", 10), ("cab", 5)]
    assert rows(search.prefix_topk(d, "t", "", 1)) == [("dog", 100)]
    assert rows(search.prefix_topk(d, "t", "ca", 0)) == []
    assert rows(search.prefix_topk(d, "other", "ca", 3)) == []


def test_ties_by_term(spark):
    d = terms(spark, cd=7, ca=7, cc=7, cb=7)
    assert [t for t, _ in rows(search.prefix_topk(d, "t", "c", 2))] == ["ca", "cb"]
    raw = spark.createDataFrame([(5, "a"), (5, "b"), (5, "c")], "score int, item string")
    assert [r[1] for r in search.topk_largest_ties(raw, "score", "item", 2).collect()] == ["c", "b"]


def test_fuzzy_cases(spark):
    d = terms(spark, cascade=3, cascading=1, zebra=1)
    assert rows(search.fuzzy_topk(d, "t", "cscade", 1, 10)) == [("cascade", 3, 1)]
    assert rows(search.fuzzy_topk(d, "t", "cascade", 0, 10)) == [("cascade", 3, 0)]
    assert rows(search.fuzzy_topk(d, "t", "cscad", 1, 10)) == []
    d = terms(spark, cat=1, cot=50, cut=20)
    assert rows(search.fuzzy_topk(d, "t", "cat", 1, 2)) == [("cot", 50, 1), ("cut", 20, 1)]


def test_wildcards_and_case_are_literal(spark):
    d = spark.createDataFrame([("t", "a%b", 1), ("t", "axb", 2), ("t", "A%", 3)], "tenant string, term string, frequency bigint")
    assert rows(search.prefix_topk(d, "t", "a%", 9)) == [("a%b", 1)]


def test_searches_equal_a_model(bulk):
    model, frame = bulk
    rng = random.Random(6)
    for q in [*rng.sample(sorted(model), 3), "é", ""]:
        for b in (0, 1, 2, 3):
            want = sorted(((w, f, distance(w.encode(), q.encode())) for w, f in model.items()), key=lambda x: (-x[1], x[0]))
            assert rows(search.fuzzy_topk(frame, "t", q, b, 7)) == [x for x in want if x[2] <= b][:7]


def test_batches_equal_single_requests(spark, bulk):
    model, frame = bulk
    queries = [*sorted(model)[::20], "", "zz", "é"]
    asked = [(i, "t", q, 1 + i % 4, i % 4) for i, q in enumerate(queries * 2)]
    requests = spark.createDataFrame(asked, "query_id bigint, tenant string, query string, k int, typo int")
    got = {}
    for r in search.prefix_topk_batch(frame, requests).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["term"], r["score"]))
    fuzzy = {}
    for r in search.fuzzy_topk_batch(frame, requests).orderBy("query_id", "rank").collect():
        fuzzy.setdefault(r["query_id"], []).append((r["term"], r["score"], r["distance"]))
    order = sorted(model.items(), key=lambda x: (-x[1], x[0]))
    for i, _, q, k, typo in asked:
        assert got.get(i, []) == [(w, f) for w, f in order if w.startswith(q)][:k]
        near = [(w, f, distance(w.encode(), q.encode())) for w, f in order]
        assert fuzzy.get(i, []) == [x for x in near if x[2] <= typo][:k]


def test_completions_equal_search(spark, bulk):
    model, frame = bulk
    table = completions.completions(frame, 5).cache()
    order = sorted(model.items(), key=lambda x: (-x[1], x[0]))
    for q in ["", *sorted(model)[::30], "none"]:
        assert rows(completions.look_up(table, "t", q, 4)) == [(w, f) for w, f in order if w.startswith(q)][:4]


def tree(words: set[bytes]) -> tuple[int, int, int]:
    marks = set(words)
    order = sorted(words)
    shared = 0
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        marks.add(b[:n])
        shared += n
    return len(marks - {b""}), len(words), sum(map(len, words)) - shared


def test_shape(spark, bulk):
    d = terms(spark, card=1204, cargo=340, cascade=91)
    assert rows(shape.tenant_stats(d)) == [("t", 5, 3, 11)]
    assert rows(shape.tenant_stats(terms(spark, cat=1, car=1))) == [("t", 3, 2, 4)]
    model, frame = bulk
    assert rows(shape.tenant_stats(frame)) == [("t", *tree({w.encode() for w in model}))]
    best = {r["prefix"]: r["max_frequency"] for r in shape.highest_below(frame).collect()}
    assert best[""] == max(model.values())


def test_byte_functions(spark):
    pairs = [("cat", "cut"), ("kitten", "sitting"), ("", "abc"), ("é", "e"), ("日本", "日木")]
    d = spark.createDataFrame(pairs, "a string, b string")
    got = d.select(bytestr.byte_levenshtein(F.col("a"), F.col("b")), bytestr.common_prefix_length(bytestr.latin1(F.col("a")), bytestr.latin1(F.col("b")))).collect()
    for (a, b), (x, n) in zip(pairs, got, strict=True):
        assert x == distance(a.encode(), b.encode())
        assert n == len([1 for i in range(1, 1 + min(len(a.encode()), len(b.encode()))) if a.encode()[:i] == b.encode()[:i]])
    step = spark.range(1).select(
        bytestr.next_row(bytestr.initial_row(F.lit(3)), F.array(*map(F.lit, "cat")), F.lit("a")).alias("r"), bytestr.row_minimum(F.array().cast("array<int>")).alias("m")
    ).first()
    assert list(step["r"]) == [1, 1, 1, 2] and step["m"] == 0


def test_key_codec(spark):
    d = spark.createDataFrame([("acme\0cascade",), ("acme\0",), ("acme\0a\0b",), ("nosep",)], "k string")
    got = [r[0] and tuple(r[0]) for r in d.select(bytestr.decode_key(F.col("k"))).collect()]
    assert got == [("acme", "cascade"), ("acme", ""), ("acme", "a\0b"), None]
    v = spark.createDataFrame([(bytearray((300).to_bytes(8, "little")),), (bytearray(b"abc"),)], "v binary")
    assert [r[0] for r in v.select(bytestr.decode_frequency(F.col("v"))).collect()] == [300, None]


def test_sums_stop_at_the_cap(spark):
    d = spark.createDataFrame([("t", "a", 2**62), ("t", "a", 2**62), ("t", "a", 2**62), ("t", "z", 0)], "tenant string, term string, weight bigint")
    assert {r["term"]: r["frequency"] for r in dictionary.from_terms(d).collect()} == {"a": 2**63 - 1, "z": 0}


def test_counts_and_empty_dictionaries(spark):
    d = terms(spark, cat=1, car=2)
    assert rows(dictionary.term_counts(d)) == [("t", 2)] and not d.isEmpty()
    none = d.limit(0)
    assert none.isEmpty() and dictionary.term_counts(none).count() == 0 and rows(dictionary.tenant_count(none)) == [(0,)]
    assert rows(search.prefix_topk(none, "t", "", 5)) == [] and shape.tenant_stats(none).count() == 0


def test_pruned_winner_and_wide_ties(spark):
    many = {f"term{i:03}": 1 for i in range(200)} | {"term199deep": 999}
    d = terms(spark, **many)
    assert rows(search.prefix_topk(d, "t", "term", 1)) == [("term199deep", 999)]
    ties = terms(spark, **{f"c{chr(97 + i)}": 7 for i in range(26)})
    want = ["ca", "cb", "cc", "cd", "ce"]
    assert [t for t, _ in rows(search.prefix_topk(ties, "t", "c", 5))] == want
    assert [r[0] for r in rows(search.fuzzy_topk(ties, "t", "ca", 1, 5))] == want


def test_more_queries_than_are_sent_to_every_task(spark, bulk, monkeypatch):
    model, frame = bulk
    asked = [(i, "t", q, 3) for i, q in enumerate(["", "a", "zz", *sorted(model)[::25]])]
    requests = spark.createDataFrame(asked, "query_id bigint, tenant string, query string, k int")
    few = sorted(rows(search.prefix_topk_batch(frame, requests)))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert sorted(rows(search.prefix_topk_batch(frame, requests))) == few and len(few) > 6
