"""Whole results of operators 6 and 10 against plain versions written from their statements."""

import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from lagfield.llm import quality, toxicity
from test_text_rules import tables
from text_fixtures import awkward, rows

MASK = 2**64 - 1


def plain_features(text, bits=20):
    words = [zlib.crc32(w.strip(b".,;:!?\"'()")) + 1 for w in (text or "").lower().encode().split()]
    found = {(w * 0x9E3779B97F4A7C15 & MASK) >> 64 - bits for w in words}
    for gap in (1, 2):
        for a, b in zip(words, words[gap:]):
            mixed = (a * 0xC2B2AE3D27D4EB4F + gap & MASK) ^ (b * 0x165667B19E3779F9 & MASK)
            found.add((mixed * 0x9E3779B97F4A7C15 & MASK) >> 64 - bits)
    return sorted(found)


def plain_scores(train, texts, rates, bits=20):
    """FTRL-proximal over (text, label) in the given order, shuffled once an epoch; the score of each of ``texts``."""
    bias, z, n = 1 << bits, {}, {}
    examples = [(plain_features(t, bits), y) for t, y in train]

    def weight(i):
        l1, zi = (0.0 if i == bias else rates.l1), z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    def score(features):
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(map(weight, [*features, bias]))))))

    order = np.random.default_rng(5)
    for _ in range(rates.epochs):
        for k in order.permutation(len(examples)):
            features, label = examples[k]
            w = {i: weight(i) for i in [*features, bias]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for i, wi in w.items():
                root = math.sqrt(n.get(i, 0.0))
                n[i] = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - root) / rates.alpha * wi
    return [score(plain_features(t, bits)) for t in texts]


def test_toxicity_scores_equal_the_plain_version(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    text = {r.doc_id: r.text for r in docs.collect()}
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    train = [(text[r.doc_id], float(r.toxic)) for r in order if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text]
    ids = sorted(text)
    want = dict(zip(ids, plain_scores(train, [text[i] for i in ids], toxicity.Rates())))
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-7) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


# The limits as the module states them, by a text's bytes.
WHOLE = [(65536, 1.3, 5.0), (4096, 1.3, 4.0), (1024, 1.2, 3.5), (256, 1.05, 3.0), (0, 0.0, 3.0)]
SHARES = [(65536, 0.05), (4096, 0.15), (0, 0.25)]


def plain_verdict(text):
    data = (text or "").encode()
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def ratio(part):
        return len(part) / len(packer.compress(part)) if part else 1.0

    low, high = next((a, b) for n, a, b in WHOLE if len(data) >= n)
    share = next(s for n, s in SHARES if len(data) >= n)
    good, total, odd = low <= ratio(data) <= high, 0, 0
    sizes = [(128, 1.0, 1.8)] if len(data) < 512 else [(256, 1.1, 2.2)]
    sizes += [(1024, 1.3, 3.0)] * (len(data) >= 2048) + [(4096, 1.3, 4.0)] * (len(data) >= 4096)
    for size, a, b in sizes:
        parts, at = [], 0
        while at + size < len(data):
            parts.append(data[at : at + size])
            at += size
        parts.append(data[-size:])  # the last one ends with the text
        outside = sum(not a <= ratio(p) <= b for p in parts)
        good &= outside <= share * len(parts)
        total, odd = total + len(parts), odd + outside
    return ratio(data), total, odd, good


def test_compression_verdicts_equal_the_plain_version(spark, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), awkward(spark)):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((i, *plain_verdict(t)) for i, t in texts), key=str)
        got = quality.quality(docs).collect()
        mine = sorted(((r.doc_id, r.ratio, r.n_chunks, r.n_odd_chunks, r.kept or r.base_failed and None) for r in got), key=str)
        assert len(mine) == len(want)
        for a, b in zip(mine, want):
            assert a[:4] == b[:4] and (a[4] is None or a[4] == b[4])
    assert len(rows()) == len(got)
