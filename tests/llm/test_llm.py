"""Each operator against a plain version, with nulls, empty texts, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termloom.llm import bpe, catalog, chat, decontaminate, licenses, near, ppm, quality, substrings, suffixes, wavelet, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, block string, h string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    words = ["the", "of", "été", "x1", "a,b", "don't", "Ünder", "日本", "zz"]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    out = [None, "", " \n\t ", "one", "a" * 300, "the " * 60, *base]
    for b in base[:6]:
        ws = b.split()
        ws[len(ws) // 2] = "changed"
        out += [b, " ".join(ws), "lead " + b + "\ntail", "\n".join([b[:80]] * 3)]
    out.append("  ".join(base[:3]) * 4)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i * 3 % 97, t) for i, t in enumerate(texts())] + [(None, texts()[8]), (3, texts()[9])]
    frame = spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "b", "h") for i, t in rows], SCHEMA)
    return rows, frame


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(t):
    return (t or "").encode()


def test_ppm(corpus, nothing):
    rows, frame = corpus
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    trie, words, docs = ppm.ByteTrie(), collections.Counter(), 0
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            low = plain(t).translate(ppm._LOWER)
            words.update(low.split())
            docs += 1
            past = ppm.PAD * ppm.ORDER
            for s in low + ppm.END:
                trie.learn(past, s)
                past = past[1:] + bytes([s])
    n, v = sum(words.values()) + docs, len(words) + 1
    want = []
    for (i, t), h in zip(rows, held, strict=True):
        c = [words[w] for w in plain(t).translate(ppm._LOWER).split()] + [docs]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        want.append((i, h, len(c), sum(x > 0 for x in c), n, round(base, 6), round(trie.score(plain(t)), 6)))
    got = [tuple(r)[:5] + (round(r[5], 6), round(r[6], 6)) for r in ppm.score(frame).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert ppm.score(nothing).count() == 0


def test_ppm_costs_are_probabilities():
    trie = ppm.ByteTrie()
    trie.score(b"abracadabra abracadabra", learn=True)
    for past in (b"acada", b"zzzzz", b"\xfe\xfe\xfe\xfea"):
        symbols = [s for s in range(256) if s != ppm.PAD[0]]
        assert abs(sum(10 ** trie.cost(past, s) for s in symbols) - 1) < 1e-9


def test_bpe_equals_the_library(corpus, nothing):
    rows, frame = corpus
    library = Tokenizer.from_file(catalog.WORD_BPE)
    rng = random.Random(1)
    letters = "abcdeéñßΣσςİı '!<|>w/1٣日́\n\t\r\x0b\x1c\xa0😀"
    odd = ["<|endoftext|>x<|startoftext|> <|endoftext|>", "</w> a</w>", "İstanbul ǅ ﬃ", "a\x00b½²x"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    odd += ["".join(rng.choice("aehinrst") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    encoder = bpe.text_encoder(catalog.WORD_BPE)
    for encode in (encoder, wavelet._encoder(catalog.WORD_BPE)):
        for t in odd:
            ids = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(encode.encode(t), "<u4").tolist() == ids
            assert encode.vocabulary.decode(np.array(ids, int)).decode() == library.decode(ids, skip_special_tokens=False)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(frame, catalog.WORD_BPE).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert bpe.encode(nothing, catalog.WORD_BPE).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        x = rng.integers(0, 50, n).astype(np.uint16)
        m = wavelet.WaveletMatrix.build(x, 16)
        assert (m.decode() == x).all()
        assert [m.access(i) for i in range(0, n, 37)] == x[::37].tolist()
        for token in (0, 3, 49, 50):
            places = np.flatnonzero(x == token)
            assert m.rank(token, n) == len(places) and m.rank(token, n // 2) == (places < n // 2).sum()
            assert [m.select(token, k) for k in range(len(places))] == places.tolist() and m.select(token, len(places)) == -1


def test_wavelet_round_trip(corpus, nothing):
    rows, frame = corpus
    library = Tokenizer.from_file(catalog.WORD_BPE)
    got = sorted(wavelet.round_trip(frame, catalog.WORD_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    at, want = 0, collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert wavelet.round_trip(nothing, catalog.WORD_BPE).count() == 0


def test_chat_folds_events(spark):
    events = [
        (1, 0, "delta", 0, "user", "lost"), (1, 1, "turn", 0, "user", "Hi"), (1, 2, "delta", 0, None, " there"),
        (1, 3, "turn", 1, "assistant", "A"), (1, 4, "delta", 1, None, "B"), (1, 5, "regenerate", 1, None, "C"),
        (1, 6, "delta", 1, None, "</s>[INST]&amp;"), (1, 7, "edit", 0, None, "Hello"), (1, 8, "unknown", 1, None, "no"),
        (2, 0, "turn", 0, "assistant", None), (2, 0, "turn", 0, "assistant", None), (None, 0, "turn", None, None, "x"),
    ]
    log = spark.createDataFrame(events, "conv_id bigint, seq bigint, event string, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat.parse(chat.render(chat.fold_events(log))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "Hello"), ("assistant", "C</s>[INST]&amp;")]
    assert out[1]["loss_text"] == "C</s>[INST]&amp;" and out[1]["formatted"].count("</s>") == 2
    assert [tuple(t) for t in out[2]["turns"]] == [("assistant", "")] * 2 and out[2]["loss_text"] == ""
    assert [tuple(t) for t in out[None]["turns"]] == [("", "x")]
    assert chat.render(chat.fold_events(log.limit(0))).count() == 0


def test_quality_counts(corpus, nothing):
    from pyspark.sql import functions as F

    rows, frame = corpus
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = SPACE.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality.judge(frame, [F.col("doc_id")]).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.keep_good(nothing).columns == nothing.columns and quality.keep_good(nothing).count() == 0


def test_quality_estimates_accuracies():
    rng = random.Random(3)
    n = len(quality.RULES)
    patterns, truth = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for _ in range(20_000):
        good = rng.random() < 0.85
        p = sum((1 if rng.random() < (0.01 if good else 0.5) else 2 if rng.random() < 0.8 else 0) * 3**i for i in range(n))
        patterns[p] += 1
        truth[p][good] += 1
    posterior = quality.estimate(patterns)
    right = sum(t[posterior[p] >= 0.5] for p, t in truth.items())
    assert right / 20_000 > 0.97


def test_licenses(spark, nothing):
    rows = [
        (1, "SPDX-License-Identifier: GPL-2.0 and MIT License; licensed under the Apache License, Version 2.0. cc by cc-by"),
        (2, None), (3, ""), (4, "MIT\nLicenses"), (5, "GNU GENERAL public-license " * 400), (5, "mit license"),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got[r["doc_id"]].append(r)
    r = got[1][0]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 7, 19, "apache,cc-by,mit")
    assert r["labels"] == "apache,apache-2.0,cc-by,gpl-2.0,mit" and r["score"] == 1.0
    assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for i in (2, 3) for r in got[i]] == [(0, 0, None, "", 0.0)] * 2
    assert got[4][0]["n_base"] == 0
    assert sorted(r["n_base"] for r in got[5]) == [1, 400]
    assert licenses.scan(nothing).count() == 0


def spelled(tree, rng):
    """A random text that a parsed regular expression matches."""
    out = ""
    for op, x in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "ANY":
            out += "q"
        elif op == "IN":
            kind, v = rng.choice(x)
            out += chr(v if str(kind) == "LITERAL" else rng.randint(*v))
        elif op == "BRANCH":
            out += spelled(rng.choice(x[1]), rng)
        elif op == "SUBPATTERN":
            out += spelled(x[3], rng)
        elif op == "MAX_REPEAT":
            low, high, part = x
            out += "".join(spelled(part, rng) for _ in range(rng.randint(low, min(low + 1, high))))
    return out


def test_license_gates_lose_no_match(spark):
    rng = random.Random(2)
    for r in licenses.rules():
        for _ in range(60):
            text = f" {spelled(re._parser.parse(r.pattern), rng).strip()} "
            assert re.search(r.pattern, text)
            words = set(text.split())
            assert words & set(r.keywords) and (not r.context or words & set(r.context)), (r, text)
    rows = [
        "released under MIT.", "distributed under the BSD 3-clause", "see zlib for details", "Governed by X11", "plain text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the ...",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "relicensed under the WTFPL",
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {
        0: ("mit", 0.75), 1: ("bsd-3-clause", 0.75), 2: ("zlib", 0.5), 3: ("mit", 0.75), 4: ("", 0.0), 5: ("mit", 1.0), 6: ("bsd", 1.0), 7: ("wtfpl", 0.75)
    }


def plain_licenses(text):
    """The labels and score of a text by all rules, without keywords."""
    words = [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    joined = f" {' '.join(words)} "
    found = [(m.start(), m.end(), r.label, r.priority, k) for k, r in enumerate(licenses.rules()) for m in re.finditer(r.pattern, joined)]
    found.sort(key=lambda d: (d[0], -d[1], -d[3], d[4]))
    kept = [d for at, d in enumerate(found) if not any(e[3] >= d[3] and e[1] >= d[1] for e in found[:at])]
    base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in joined}
    labels = sorted(base | {d[2] for d in kept})
    return ",".join(labels), max([d[3] for d in kept] + [2] * bool(base), default=0) / 4


def test_licenses_equal_a_plain_version(spark):
    rng = random.Random(8)
    rules = licenses.rules()
    rows = [None, "", "the gnu gpl"]
    for _ in range(300):
        parts = [spelled(re._parser.parse(rng.choice(rules).pattern), rng).strip() for _ in range(rng.randint(1, 4))]
        rows.append(rng.choice([" ", " and ", ". ", "\n"]).join(parts).title())
    rows.append("word " * 200_000 + "MIT license " + "word " * 50_000)
    schema = "doc_id bigint, text string, _w string, label string, key string"
    got = licenses.scan(spark.createDataFrame([(i, t, "x", "y", None) for i, t in enumerate(rows)], schema)).collect()
    for r in got:
        assert (r["labels"], r["score"]) == plain_licenses(rows[r["doc_id"]]), rows[r["doc_id"]][:300]


def test_decontamination(spark, corpus, nothing):
    rng = random.Random(3)
    items = [(k, "".join(rng.choice("abcdefgh ") for _ in range(n))) for k, n in ((1, 90), (2, 200), (3, 20), (4, 5), (5, 0))]
    items += [(6, None), (None, "some text without an id"), (1, items[0][1])]
    index = decontaminate.Index([(k, t.encode()) for k, t in items[:5]])

    def edits(p, t):
        if len(p) < decontaminate.Q:
            word = rb"[a-z0-9\x80-\xff]"
            left, right = (rb"(?<!" + word + rb")" if re.match(word, p) else b""), (rb"(?!" + word + rb")" if re.match(word, p[-1:]) else b"")
            return 0 if re.search(left + re.escape(p) + right, t) else 1
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, e in enumerate(t):
                new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    docs = []
    for n in range(30):
        t = list(rng.choice(items[:3])[1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([["z"], [], ["z", t[at]]])
        docs.append((n, "lead " * rng.randint(0, 9) + "".join(t).upper() + "\ntail"))
    want = set()
    for n, t in docs:
        for at, (k, item) in enumerate(items[:4]):
            e = edits(index.texts[at], decontaminate.fold(t.encode()))
            if e <= decontaminate.budget(len(item)):
                want.add((n, k, e))
    frame = spark.createDataFrame([*docs, (99, None), (98, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.matches(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == want and len(got) == len(want)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _, _ in want} | {99, 98}
    assert decontaminate.matches(frame, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(nothing, bench).columns == nothing.columns


def cut(rows, parts, size):
    first = {}
    for i, x in rows:
        if i is not None:
            for k in range(len(x) - size + 1):
                w = parts(x[k : k + size])
                first[w] = min(first.get(w, i), i)
    for i, x in rows:
        gone = [False] * len(x)
        if i is not None:
            for k in range(len(x) - size + 1):
                if first[parts(x[k : k + size])] < i:
                    gone[k : k + size] = [True] * size
        yield i, x, gone


def test_substrings(corpus, nothing):
    rows, frame = corpus
    words = [(i, plain(t).split()) for i, t in rows]
    for size in (13, 5, 30):
        want = collections.Counter(
            (i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for i, w, g in cut(words, tuple, size)
        )
        assert collections.Counter(tuple(r) for r in substrings.digests(frame, size).collect()) == want
    assert substrings.digests(nothing).count() == 0 and substrings.lengths(50) == [7, 13, 25, 50]


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(3000):
        k = rng.choice([1, 2, 3, 5])
        x = [rng.randint(0, k) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffixes(corpus, nothing):
    rows, frame = corpus
    want = collections.Counter()
    for i, x, g in cut([(i, plain(t)) for i, t in rows], bytes, 50):
        kept = bytes(b for b, y in zip(x, g, strict=True) if not y)
        spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        want[i, len(x), sum(g), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffixes.digests(frame).collect()) == want
    out = suffixes.remove_repeats(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    assert suffixes.digests(nothing).count() == 0


def test_suffixes_in_little_memory():
    """Ranges of anchors are even, and one anchor's fragments are sorted in some bytes a letter."""
    rng = random.Random(4)
    text = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(30_000)).encode()
    ranges = np.bincount((suffixes._Fragments([1], [text], suffixes.SIZE, suffixes.SHORT).anchors >> np.uint64(58)).astype(int), minlength=64)
    assert ranges.max() <= 3 * ranges.mean() and ranges.min() > 0
    fragments = [bytes(rng.choice(b"abc") for _ in range(75)) for _ in range(600)]
    tracemalloc.start()
    suffixes.smallest_ids(fragments, list(range(600)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 85 * sum(map(len, fragments)), peak / sum(map(len, fragments))


def test_edits_within():
    rng = random.Random(0)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, e in enumerate(b):
                new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert all(near.edits_within(a, b, k) == (distance(a, b) <= k) for k in range(6))
    for _ in range(800):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            at = rng.randrange(len(b) + 1)
            b[at : at + 1] = rng.choice([[], ["x"], ["y", "a"]])
        d = distance(a, b)
        for k in {k for k in (1, 2, 5, 9, 13, 20, d - 1, d, d + 1) if abs(len(a) - len(b)) <= k < len(a)}:
            assert near._band_edits(a, b, k) == (d <= k) == near.edits_within(a, b, k)


def test_near_duplicates(corpus, nothing):
    rows, frame = corpus
    ids = sorted({i for i, t in rows if i is not None})
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and any(x.split() and y.split() and near.similar(x, y) for x in by_id[a] for y in by_id[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near.classes(frame).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(i, find(i)) for i in ids} | {(None, None)}
    kept = [r["doc_id"] for r in near.keep_first(frame).collect()]
    # an id with several texts stays with each of them
    assert sorted(i for i in kept if i is not None) == sorted(i for i in {find(i) for i in ids} for _ in {" ".join(t.split()) for t in by_id[i]}) and kept.count(None) == 1
    assert near.classes(nothing).count() == 0


def edited(words, places):
    return [f"new{i}" if i in places else w for i, w in enumerate(words)]


def linked(spark, texts, sketches):
    """Links between texts whose sketches are given."""
    schema = "doc_id bigint, n_words bigint, sketches array<bigint>, signature binary"
    nodes = spark.createDataFrame([(i, len(t.split()), s, near.signature(words.word_hashes(t))) for i, (t, s) in enumerate(zip(texts, sketches, strict=True))], schema)
    got = near.links(nodes, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {tuple(sorted(r)) for r in got}


def test_near_pairs_that_a_leader_separates(spark):
    lead = [f"w{i}" for i in range(100)]
    middle = edited(lead, range(0, 12))
    last = edited(middle, range(50, 62))
    texts = [" ".join(t) for t in (lead, middle, last)]
    assert near.similar(texts[0], texts[1]) and near.similar(texts[1], texts[2]) and not near.similar(texts[0], texts[2])
    assert linked(spark, texts, [[1]] * 3) == {(0, 1), (1, 2)}


def test_near_copies_that_share_a_passage_with_a_leader(spark):
    rng = random.Random(3)
    shared = [f"p{i}" for i in range(70)]
    texts, sketches = [], []
    for k in range(10):
        one = shared + [f"k{k}x{i}" for i in range(30)]
        texts += [" ".join(t) for t in (shared + [f"k{k}y{i}" for i in range(30)], one, edited(one, set(rng.sample(range(70, 100), 15))))]
        sketches += [[k]] * 3
    assert linked(spark, texts, sketches) == {(3 * k + 1, 3 * k + 2) for k in range(10)}


def test_near_large_buckets(spark):
    """One bucket in several blocks: pairs are all the similar ones, up to what is in one component."""
    rng = random.Random(5)
    texts = []
    for k in range(170):
        one = [f"k{k}x{i}" for i in range(20)] + ["same"] * 5
        texts += [" ".join(one)] + [" ".join(edited(one, set(rng.sample(range(25), 4)))) for _ in range(3)]
    rng.shuffle(texts)
    roots = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(sorted(linked(spark, texts, [[1]] * len(texts))), "a bigint, b bigint")).collect()}
    groups = collections.defaultdict(set)
    for i, root in roots.items():
        groups[root].add(i)
    assert sorted(len(g) for g in groups.values()) == [4] * 170
    assert all(len({next(w for w in texts[i].split() if w[0] == "k").split("x")[0] for i in g}) == 1 for g in groups.values())


def test_near_candidates_at_the_threshold():
    rng = random.Random(1)

    def met(n, edits):
        one = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        two = list(one)
        for p in rng.sample(range(n), edits):
            two[p : p + 1] = rng.choice([["z"], ["z"], [two[p], "z"]]) if n < 200 else [f"z{p}"]
        return bool(np.isin(near.sketch(words.word_hashes(" ".join(one))), near.sketch(words.word_hashes(" ".join(two)))).any())

    assert all(met(n, n // 5) for n in range(5, 25) for _ in range(100))
    for n in (26, 30, 40, 100, 300):
        assert sum(met(n, n // 5) for _ in range(300)) >= 270


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(102, 101), (103, 102), (200, 101), (300, 299)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {101: 101, 102: 101, 103: 101, 200: 101, 299: 299, 300: 299}


def test_wavelet_files(spark, corpus, tmp_path):
    rows, frame = corpus
    wavelet.write(frame, catalog.WORD_BPE, str(tmp_path / "ids"), 1, shard_tokens=300)
    shards = wavelet.read(spark, str(tmp_path / "ids"))
    sizes = [r["n_tokens"] for r in shards.select("n_tokens").collect()]
    assert len(sizes) > 4 and sum(sizes) > 300 * len(sizes) / 2
    assert len(list((tmp_path / "ids").glob("part-*"))) == len(sizes)
    library = Tokenizer.from_file(catalog.WORD_BPE)
    order = sorted(wavelet.documents(shards).collect(), key=lambda r: r["start"])
    left, every = collections.defaultdict(list), []
    for i, t in rows:
        left[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for r in order:
        found = next(x for x in left[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        left[r["doc_id"]].remove(found)
        every += found
    asked = [0, 1, 299, len(every) // 2, len(every) - 1, len(every), -1]
    places = spark.createDataFrame([(p,) for p in asked * 2], "position bigint")
    assert {r["position"]: r["token"] for r in wavelet.access(shards, places).collect()} == {p: every[p] if 0 <= p < len(every) else None for p in asked}
    tokens = [1, every[3], every[-2], 60_000, 5]
    assert {r["token"]: r["n"] for r in wavelet.count(shards, tokens).collect()} == {x: every.count(x) for x in tokens}
    got = sorted((r["token"], r["number"], r["position"]) for r in wavelet.locate(shards, tokens).collect())
    assert got == sorted((x, n, p) for x in set(tokens) for n, p in enumerate(p for p, y in enumerate(every) if y == x))


def plain_features(text):
    w = SPACE.findall(text or "")
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    repeated = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return {
        "n_words": len(w), "n_symbols": sum(x in "#*$%&|<>" for x in text or ""), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_distinct": sum(len(set(w[k : k + 100])) for k in range(0, len(w), 100)),
        "n_stutter": sum(x == y for x, y in zip(w, w[1:])), "word_chars": sum(map(len, w)), "n_function": len(set(w) & set(quality.FUNCTION_WORDS)),
    }


def plain_quality(texts):
    """Whether each text is kept; the rules' conditions are read as Python, their numbers from EM."""
    written = [[re.sub(r"(\w+) between (.+?) and (.+)$", r"(\2 <= \1 <= \3)", c).replace(" = ", " == ") for c in pair] for pair in quality.RULES.values()]
    seen = [plain_features(t) for t in texts]
    patterns = [sum((1 if eval(bad, {}, f) else 2 if eval(good, {}, f) else 0) * 3**i for i, (bad, good) in enumerate(written)) for f in seen]
    posterior = quality.estimate(collections.Counter(patterns))
    return [f["n_words"] >= 20 and 100 * f["n_repeat_words"] <= 30 * f["n_words"] and posterior[p] >= 0.5 for f, p in zip(seen, patterns, strict=True)]


def test_quality_verdicts(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, [F.col("doc_id")]).collect()}
    assert got == dict(zip([i for i, _ in rows], plain_quality([t for _, t in rows]), strict=True))
    assert 0 < sum(got.values()) < len(rows)


def semi_global(p, t):
    """The fewest edits that turn p into some part of t."""
    t = np.frombuffer(t, np.uint8)
    row, steps = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(p):
        new = np.r_[i + 1, np.minimum(row[:-1] + (t != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def plain_pipeline(docs, items):
    """doc_id -> (ids, decoded), by plain versions of all stages."""
    kept = [d for d, good in zip(docs, plain_quality([t for _, t in docs]), strict=True) if good]
    ids = sorted(i for i, _ in kept)
    by_id, root = dict(kept), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and near.similar(by_id[a], by_id[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [(i, by_id[i].encode()) for i in ids if find(i) == i]
    cut_texts = {i: bytes(b for b, g in zip(x, gone, strict=True) if not g).decode(errors="ignore") for i, x, gone in cut(kept, bytes, 50)}
    folded = [decontaminate.fold(t.encode()) for t in items]
    library = Tokenizer.from_file(catalog.WORD_BPE)
    out = {}
    for i, t in cut_texts.items():
        data = decontaminate.fold(t.encode())
        if not any(semi_global(p, data) <= decontaminate.budget(len(p)) for p in folded):
            found = library.encode(t, add_special_tokens=False).ids
            out[i] = (found, library.decode(found, skip_special_tokens=False))
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (_, stage), keeps_columns in zip(corpus_pipeline.STAGES, [True] * 4 + [False], strict=True):
        out = stage(spark, docs.limit(0), SF)
        assert (not keeps_columns or out.columns == docs.columns) and out.count() == 0
    rng = random.Random(4)
    rows = [r for r in docs.where("doc_id < 110").collect() if len(r["text"] or "") < 20_000]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    made = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    for k, r in enumerate(r for r in rows if len(r["text"].split()) > 60):
        words = r["text"].split()
        for at in rng.sample(range(len(words)), len(words) // 20):
            words[at] = f"new{at}"
        extra = [" ".join(words), "lead " + r["text"][-400:] + " " + " ".join(f"own{k}x{j}" for j in range(40)), r["text"] + " " + items[k % 6].upper()]
        made.append((1000 + k, extra[k % 3], r["lang"], r["source"], 1))
    spark.createDataFrame(made, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain_pipeline([(i, t) for i, t, *_ in made], items)
    assert got == want and 10 < len(want) < len(made)
    assert public_tokenizers.path("word_bpe_49k.json") == catalog.WORD_BPE


def test_very_long_texts(spark, nothing):
    """Texts of megabytes, of many words, of one word and of one repeated byte, beside short ones."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200_000)]
    long, other = " ".join(words), " ".join([*words[:199_000], "end"])
    rows = [(1, long), (2, other), (3, "x" * 1_000_000), (4, " " * 300_000), (5, "ab" * 200_000), (6, long), (7, "short text")]
    schema = "doc_id bigint, text string, seq string, turn string, role string"
    docs = spark.createDataFrame([(i, t, "s", None, "r") for i, t in rows], schema).repartition(4)
    by_id = dict(rows)
    assert dict(near.classes(docs).collect()) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7}
    got = {r["doc_id"]: r for r in substrings.digests(docs).collect()}
    assert (got[1]["n_removed"], got[6]["n_removed"], got[2]["n_removed"], got[3]["n_words"]) == (0, 200_000, 199_000, 1)
    got = {r["doc_id"]: r for r in suffixes.digests(docs).collect()}
    assert (got[1]["n_removed"], got[6]["n_removed"], got[3]["n_bytes"], got[5]["n_removed"]) == (0, len(long), 1_000_000, 0)
    got = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    assert got[1]["n_tokens"] == 200_001 and abs(got[1]["score"] - got[6]["score"]) < 1e-6
    library = Tokenizer.from_file(catalog.WORD_BPE)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i in (1, 4, 7)}
    got = {r["doc_id"]: r for r in bpe.encode(docs, catalog.WORD_BPE).collect()}
    assert all(list(got[i]["ids"]) == x for i, x in ids.items())
    got = {r["doc_id"]: r for r in wavelet.round_trip(docs, catalog.WORD_BPE).collect()}
    assert all(got[i]["n_tokens"] == len(x) + 1 for i, x in ids.items())
    got = {r["doc_id"]: r for r in quality.judge(docs, [F.col("doc_id")]).collect()}
    assert (got[1]["n_words"], got[3]["n_words"], got[4]["n_words"]) == (200_000, 1, 0)
    items = spark.createDataFrame([(1, long[500_000:500_300]), (2, " " * 200), (3, "ab" * 100 + "never there" * 9), (4, "short"), (5, "hort")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert found >= {(1, 1), (6, 1), (4, 2), (7, 4)} and not {x for x in found if x[1] in (3, 5)}
    assert dict((r["doc_id"], r["n_words"]) for r in licenses.scan(docs).collect()) == {i: len(t.split()) for i, t in by_id.items()}
    chats = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text", "seq", F.lit("x").alias("es"))
    out = chat.digests(chat.parse(chat.render(chat.fold_events(chat.as_events(chats))))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in out} == {i: (1, len(t)) for i, t in rows}


def test_repeated_rows_of_one_id(spark):
    rows = [(1, "some words that are here and stay", "a"), (1, "some  words that are here and stay", "a"), (1, "quite another text of the same id", "b"), (2, "", "c"), (None, "x", "d"), (None, "x", "d")]
    kept = near.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, _id string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[4], rows[5]]))


def test_near_recall(spark):
    """Random edits at rates up to the budget: of all pairs that are similar by alignment, at
    least nine tenths are in one class, at every length."""
    rng = random.Random(12)
    texts, pairs = [], []
    for n in (5, 8, 12, 20, 26, 40, 60, 100, 400):
        for rate in (0.05, 0.1, 0.15, 0.19):
            for _ in range(25 if n < 400 else 8):
                one = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
                two = list(one)
                for _ in range(int(rate * n)):
                    at = rng.randrange(len(two))
                    two[at : at + 1] = rng.choice([["z"], [], [two[at], f"y{rng.randint(0, 99)}"]])
                pairs.append((n, len(texts), len(texts) + 1))
                texts += [" ".join(one), " ".join(two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    of = dict(near.classes(docs).collect())
    met = collections.defaultdict(list)
    for n, a, b in pairs:
        if near.similar(texts[a], texts[b]):
            met[n].append(of[a] == of[b])
    assert len(met) == 9 and all(sum(x) >= 0.9 * len(x) for x in met.values()), {n: sum(x) / len(x) for n, x in met.items()}
    print({n: round(sum(x) / len(x), 3) for n, x in met.items()})


def test_near_crowds(spark, monkeypatch):
    """A bucket that is cut by parts of the signature still gives its pairs."""
    monkeypatch.setattr(near, "CROWD", 30)
    rng = random.Random(3)
    shared = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(40):
        one = shared + [f"k{k}x{i}" for i in range(70)]
        texts += [" ".join(one), " ".join(edited(one, set(rng.sample(range(30, 100), 15))))]
    assert linked(spark, texts, [[1]] * len(texts)) == {(2 * k, 2 * k + 1) for k in range(40)}


def test_near_crowds_are_dealt_into_few_rows(spark, monkeypatch):
    """A passage in common does not make rows for every two bytes of every signature."""
    monkeypatch.setattr(near, "CROWD", 30)
    rng = random.Random(4)
    shared = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(50):
        one = shared + [f"k{k}x{i}" for i in range(60)]
        texts += [" ".join(one), " ".join(edited(one, set(rng.sample(range(40, 100), 15))))]
    texts += [" ".join(shared + [f"s{k}x{i}" for i in range(60)]) for k in range(50)]
    made, every, pair_off = [], near._all_pairs, near._pair_off

    def each_row(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_id")], ["doc_id", "leader"])

    def counted(*args):
        monkeypatch.setattr(near, "_pair_off", each_row)
        made.append(every(*args).count())
        monkeypatch.setattr(near, "_pair_off", pair_off)
        return every(*args)

    monkeypatch.setattr(near, "_all_pairs", counted)
    assert linked(spark, texts, [[1]] * len(texts)) == {(2 * k, 2 * k + 1) for k in range(50)}
    assert 0 < made[0] <= 21 * len(texts), made


def test_near_lengths_in_two_bands(spark, monkeypatch):
    """Pairs of unlike lengths in a bucket of several blocks, which goes by bands of length."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = random.Random(2)
    texts = []
    for k in range(40):
        one = [f"k{k}x{i}" for i in range(60 + 3 * k)]
        texts += [" ".join(one), " ".join(w for i, w in enumerate(one) if i >= len(one) // (5 + k % 3))]
    texts += [" ".join(f"s{k}x{i}" for i in range(rng.randint(50, 180))) for k in range(40)]
    assert linked(spark, texts, [[1]] * len(texts)) == {(2 * k, 2 * k + 1) for k in range(40)}


def test_near_similar_texts_share_a_rare_word():
    rng = random.Random(6)
    for n in range(600):
        one = [f"w{rng.randint(0, rng.choice([3, 30, 3000]))}" for _ in range(rng.randint(4, 120))]
        two = list(one)
        for _ in range(rng.randint(0, len(one) // 5 + 1)):
            at = rng.randrange(len(two))
            two[at : at + 1] = rng.choice([["z"], [], [two[at], f"y{rng.randint(0, 9)}"]])
        frequency = np.random.default_rng(n).integers(0, 5, near.SLOTS)
        a, b = (near.rarest(words.word_hashes(" ".join(t)), frequency) for t in (one, two))
        assert len(a) == int(0.2 * len(one) + 1e-9) + 1
        if near.similar_words(one, two):
            assert np.isin(a, b).any()


def test_near_crowds_give_the_same_links(spark, monkeypatch):
    """Similar texts whose signatures agree in scattered bytes only, in a bucket of either size."""
    rng = random.Random(8)
    texts = []
    while len(texts) < 8:
        one = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        two = edited(one, set(rng.sample(range(200), 40)))
        x, y = (np.frombuffer(near.signature(words.word_hashes(" ".join(t))), np.uint8) for t in (one, two))
        if near.alike(x[None], y[None])[0] and not (x == y).reshape(-1, 4).all(axis=1).any():
            texts += [" ".join(one), " ".join(two)]
    few = linked(spark, texts, [[1]] * len(texts))
    monkeypatch.setattr(near, "CROWD", 0)
    assert few == linked(spark, texts, [[1]] * len(texts)) == {(2 * k, 2 * k + 1) for k in range(4)}


def test_near_signatures_that_agree_share_two_bytes():
    rng = np.random.default_rng(1)
    for n in range(3000):
        x = rng.integers(1, 256, near.BINS, np.uint8) * (rng.random(near.BINS) < rng.choice([0.03, 0.2, 0.9, 1])).astype(np.uint8)
        y = x.copy()
        either = rng.permutation(near.BINS) if n % 4 else np.r_[np.arange(n % 8 // 4, near.BINS, 2), np.arange(1 - n % 8 // 4, near.BINS, 2)]
        for i in either[x[either] > 0][: np.count_nonzero(x) // 2]:
            y[i] = 0 if rng.random() < 0.3 else x[i] % 255 + 1
        if x.any() and near.alike(x[None], y[None])[0]:
            assert any(x[i] == y[i] and x[j] == y[j] and (x[i] or x[j]) for i, j in near.TWOS)


def test_decontamination_of_repetitive_texts(spark):
    rng = random.Random(9)
    pieces = lambda: b"".join(rng.choice([b" ", b"a" * rng.randint(1, 40), b"ab" * rng.randint(1, 20), b"-" * rng.randint(1, 30), bytes(rng.choice(b"abcdefgh") for _ in range(9))]) for _ in range(6))
    items = [p for p in (pieces() for _ in range(12)) if len(p) >= decontaminate.Q]
    docs = []
    for _ in range(30):
        t = bytearray(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([b"z", b"", bytes([122, t[at]])])
        docs.append((pieces() + bytes(t) + pieces()).decode())
    rows = [(n // 2, t) for n, t in enumerate(t for t in docs for _ in range(2))]  # each row twice
    got = collections.Counter(tuple(r)[:3] for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k, p.decode()) for k, p in enumerate(items)], "item_id bigint, text string")).collect())
    want = {(n, k, e): 2 for n, t in enumerate(docs) for k, p in enumerate(items) if (e := semi_global(p, decontaminate.fold(t.encode()))) <= decontaminate.budget(len(p))}
    assert got == want


def test_word_hashes():
    rng = random.Random(5)
    texts = ["", " \t", "a", "é été  e\x1c\u00a0x", *["".join(rng.choice("ab \n\x0b\x1cé日") for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    texts.append("long" * 300_000 + " " + "word " * 200_000)
    hashes, counts = words.hashes_of([t.encode() for t in texts])
    every = [SPACE.findall(t) for t in texts]
    assert counts.tolist() == [len(w) for w in every]
    of = {}
    for word, h in zip((w for t in every for w in t), hashes.tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    assert words.hashes_of([])[0].tolist() == [] and words.word_hashes("").tolist() == []


def test_near_one_component_and_others(spark):
    """A bucket that is mostly one component, in several blocks, beside other pairs and one
    document that links to it only through a member that is no leader."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(edited(base, set(rng.sample(range(50), 5)))) for _ in range(600)]
    far = edited(texts[300].split(), set(rng.sample(range(50, 100), 18)))
    assert near.similar(texts[300], " ".join(far)) and sum(near.similar(t, " ".join(far)) for t in texts) < 600
    texts.append(" ".join(far))
    for k in range(20):
        one = [f"k{k}x{i}" for i in range(100)]
        texts += [" ".join(one), " ".join(edited(one, set(rng.sample(range(100), 15))))]
    found = sorted(linked(spark, texts, [[1]] * len(texts)))
    roots = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    assert {roots[i] for i in range(601)} == {0}
    assert all(roots[601 + 2 * k] == roots[602 + 2 * k] == 601 + 2 * k for k in range(20))
    assert all(near.similar(texts[a], texts[b]) for a, b in found)


def test_wavelet_steps_equal_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    bits = "' 's 'S 're 'RE 've 'll 'lL 'd 'm 't '' a B é É ß ÿ Ÿ × ÷ Ⱥ Ⱦ ȿ ɐ İ ı ſ ŉ ² ½ 1 23 ( — « <| |> <|endoftext|> <|ENDOFTEXT|> _ H̱ 日本 ț word l e r s Σ".split(" ")
    bits += [" ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "　", "́", "\x00", "\x7f"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    some.append(" ".join(rng.choice(["one", "don't", "Été,", "x1"]) for _ in range(3000)))
    wanted = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    encoder = wavelet.LibraryEncoder(bpe.Vocabulary(path), 2)
    looked_up = []
    encode = encoder.pieces.encode
    encoder.pieces.encode = lambda piece: looked_up.append(piece) or encode(piece)
    for size in (wavelet.STEP_BYTES, 1000):  # the last text is cut at white space
        monkeypatch.setattr(wavelet, "STEP_BYTES", size)
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_each(t.encode() for t in some)] == wanted
    assert len(looked_up) == len(set(looked_up))
    assert list(encoder.encode_each([])) == []


def test_wavelet_planes_in_parts(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 49408, 5000).astype("<u2")
    given = ids.copy()
    whole = wavelet.WaveletMatrix.build(ids, 16)
    for part in (8, 512, 1024):
        monkeypatch.setattr(wavelet, "PART", part)
        cut = wavelet.WaveletMatrix.build(ids, 16)
        assert cut.zeros == whole.zeros and all((a == b).all() for a, b in zip(cut.planes + cut.ranks, whole.planes + whole.ranks, strict=True))
        assert (cut.decode() == given).all() and (ids == given).all()


def test_near_pairs_come_out_once(spark, monkeypatch):
    """Texts just below the threshold that share many buckets: a pair comes out of one of them, and
    not at all where the words that the other lacks are too many."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for k in range(30):
        one = [f"n{k}x{i}" if i in places else w for places in [set(rng.sample(range(100), 16))] for i, w in enumerate(base)]
        texts += [" ".join(one), " ".join(edited(one, set(rng.sample(range(100), 6))))]
    wanted = {(a, b) for b in range(60) for a in range(b) if near.similar(texts[a], texts[b])}
    assert wanted
    nodes = spark.createDataFrame([(i, 100, near.signature(words.word_hashes(t))) for i, t in enumerate(texts)], "doc_id bigint, n_words bigint, signature binary")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = [(k, i, 100, i) for i in range(60) for k in rng.sample(range(-6, 6), 9)]
    met = {(a, b) for k in range(-6, 6) for ids in [sorted(i for x, i, _, _ in keys if x == k)] for n, b in enumerate(ids) for a in ids[:n]}
    active = spark.createDataFrame(keys, "key bigint, doc_id bigint, n_words bigint, root bigint")
    for block in (near.BLOCK, 8):
        monkeypatch.setattr(near, "BLOCK", block)
        found = [(r["leader"], r["doc_id"]) for r in near._all_pairs(active, nodes.select("doc_id", "signature"), frame).collect()]
        assert len(found) == len(set(found)) < len(met) / 4
        assert wanted & met <= set(found) <= met


def test_near_fewer_edges_make_the_same_components(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(edited(base, set(rng.sample(range(100), 12)))) for _ in range(60)]
    nodes = spark.createDataFrame([(i, 100, [1, 2], near.signature(words.word_hashes(t))) for i, t in enumerate(texts)], "doc_id bigint, n_words bigint, sketches array<bigint>, signature binary")
    every, fewer = near.search(nodes, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    roots = [sorted(tuple(r) for r in near.components(e).collect()) for e in (every, fewer)]
    assert roots[0] == roots[1] and fewer.count() <= every.count()
