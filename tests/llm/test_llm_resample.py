import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import cases
import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowmatch.llm import resample

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, run):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORDS.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute_force(rows, target, run=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    made = [(i, *plain_features(text, run)) for i, text in rows]
    s = Counter(bucket(f) for _, _, fs in made for f in fs)
    t = Counter(bucket(f) for text in target for f in plain_features(text, run)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    scored = []
    for i, words, fs in made:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        u = (int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        scored.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(words) >= least))
    fit = sorted((r for r in scored if r[-1]), key=lambda r: (-r[3], (r[0] is not None, r[0] or 0), r[1]))
    drawn = percent * len(fit) // 100
    out = [(*r[:4], n + 1 if n < drawn else None) for n, r in enumerate(fit)]
    return sorted(out + [(*r[:4], None) for r in scored if not r[-1]], key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def corpus():
    text = lambda i: " ".join(f"W{(i * 31 + j * j) % 211} é{j % 7}x" for j in range(i % 40))
    return [(i, text(i)) for i in range(300)]


def test_draws_equal_brute_force(spark):
    rows, target = corpus(), ["w3 w5 é1x W7", "", None, "w3 w3"]
    docs = cases.documents(spark, [(i, t, None) for i, t in rows], partitions=4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"run": 3}, {"percent": 50, "buckets": 64}, {"percent": 100}, {"percent": 0}):
        names = {"buckets": "buckets", "run": "run", "percent": "percent"}
        got = found(resample.resample(docs, goal, **options))
        assert got == brute_force(rows, target, **{names[k]: v for k, v in options.items()})


def test_odd_rows_equal_brute_force(spark):
    docs = cases.documents(spark)
    goal = spark.createDataFrame([("the cat",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(resample.resample(docs, goal, least_words=5, percent=70)) == brute_force(rows, ["the cat"], least=5, percent=70)


def test_copies_get_ranks_of_their_own(spark):
    docs = cases.documents(spark, [(7, "a b c " * 10, None)] * 60 + [(None, "d e f " * 10, None)] * 40)
    got = resample.resample(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101))


def test_empty_tables(spark):
    empty = cases.empty(spark)
    assert resample.resample(empty, empty).collect() == []
    docs = cases.documents(spark, [(i, t, None) for i, t in corpus()])
    assert found(resample.resample(docs, empty)) == brute_force(corpus(), [])


def test_chunks_do_not_change_the_buckets():
    texts = [t.encode() for _, t in corpus()] + [None, b"", b"x" * 100_000]
    whole = resample._hashed(texts, 2, 97)
    parts = [resample._hashed([t], 2, 97) for t in texts]
    for k in range(3):
        assert np.array_equal(whole[k], np.concatenate([p[k] for p in parts]))


@given(st.lists(st.binary(max_size=300), unique=True, max_size=60))
def test_checksums_of_mixed_lengths(values):
    assert resample.crc32_of(values).tolist() == [zlib.crc32(v) for v in values]


@given(st.text(), st.integers(1, 3))
def test_words_and_runs(text, run):
    got = resample.features(resample.words(text.encode("utf-8", "ignore")), run)
    assert [f.decode() for f in got] == plain_features(text.encode("utf-8", "ignore").decode(), run)[1]


def test_bounded_range_of_scores(spark):
    keys = spark.range(5_000).select(resample.gumbel(F.col("id")).alias("g")).collect()
    assert all(-4_000 < r["g"] < 23_000 for r in keys)
