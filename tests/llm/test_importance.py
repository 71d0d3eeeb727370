"""Operator 13 against brute force, and on awkward tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lagfield.llm import importance
from text_fixtures import awkward, empty, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, longest=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """docs: (doc_id, text) in stored order of equal ids; (doc_id, n_features, weight, score, rank)."""
    s, t = collections.Counter(), collections.Counter()
    for many, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            many.update(zlib.crc32(g.encode()) % buckets for g in grams(x, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, own = grams(text, longest)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in own)
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    aims = [r.text for r in target.collect()]
    for settings in ({}, {"longest": 3, "buckets": 500, "percent": 37, "seed": 5}):
        theirs = {"least" if k == "least_words" else k: v for k, v in settings.items()}
        got = importance.resample(docs, target, **settings)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert [t for _, t in got.dtypes] == ["bigint"] * 5
        assert collections.Counter(map(tuple, got.collect())) == brute(texts, aims, **theirs)


def test_awkward_rows(spark):
    own = [(r[0], r[1]) for r in rows()]
    target = spark.createDataFrame([(1, "The QUICK brown fox é"), (2, None), (3, "")], "item_id long, text string")
    got = importance.resample(awkward(spark), target, percent=50)
    want = brute(own, ["The QUICK brown fox é"], percent=50)
    assert collections.Counter(map(tuple, got.collect())) == want
    none = importance.resample(awkward(spark), target.where("false"), percent=50)
    assert collections.Counter(map(tuple, none.collect())) == brute(own, [], percent=50)
    assert importance.resample(empty(spark), target).count() == 0
    nulls = awkward(spark).withColumn("text", F.lit(None).cast("string"))
    assert {tuple(r)[1:3] for r in importance.resample(nulls, target, least_words=0).collect()} == {(0, 0)}


def test_very_long_texts_and_equal_rows(spark):
    long = [(1, "word " * 2_000_000), (2, "x" * 10_000_000), (3, "a\nb " * 1_000_000)]
    hot = [(9, "one text that a third of all rows share " * 3)] * 40
    docs = spark.createDataFrame(long + hot, "doc_id long, text string")
    target = spark.createDataFrame([(1, "one text word")], "item_id long, text string")
    got = importance.resample(docs, target, percent=100)
    assert collections.Counter(map(tuple, got.collect())) == brute(long + hot, ["one text word"], percent=100)


def test_features_of_one_batch():
    texts = pa.array(["Ab ab", None, "", "c", "ab c ab"])
    counts = [(own.tolist(), len(taken)) for own, taken, _ in importance.features(texts, longest=3)]
    assert counts == [([2, 0, 0, 1, 3], 6), ([1, 0, 0, 0, 2], 3), ([0, 0, 0, 0, 1], 1)]
    (_, taken, words), *_ = importance.features(texts)
    assert words.tolist() == [2, 0, 0, 1, 3] and taken[0] == zlib.crc32(b"ab") % 10_000
    assert len(list(importance.features(pa.array([], pa.string()), longest=2))) == 2
    assert (importance.gains(np.array([0, 3]), np.array([0, 3])) == 0).all()
