"""The pipeline against a brute-force version of its stages, and its behaviour on awkward tables."""

import collections
import os
import zlib

import numpy as np

import corpus_pipeline
from lagfield.llm import secret_scan, tokens, toxicity
from test_duplicates import naive_components, naive_fingerprint, normal
from text_fixtures import awkward, empty


def brute_force(model, docs):
    """docs: (doc_id, text, source); what is left to pack, as {doc_id: text}."""
    kept = [d for d in docs if model.score(d[1]) < 0.5]
    first = {}
    for d in sorted(kept, key=lambda d: d[0]):
        first.setdefault(normal(d[1]), d)
    kept = list(first.values())
    roots = naive_components([naive_fingerprint(d[1]) for d in kept])
    best = {}
    for d, r in sorted(zip(kept, roots), key=lambda x: x[0][0]):
        best.setdefault(r, d)
    kept = list(best.values())
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    found = {d[0]: secret_scan.candidates(d[1] or "") for d in kept}
    for doc_id, text, source in kept:
        for c in found[doc_id]:
            owners[c[4]].add(source)
            repos[c[4]].add(text)

    def copied(value):
        return len(owners[value]) >= 3 or len(owners[value]) > 1 and len(repos[value]) >= 10

    out = {}
    for doc_id, text, _ in kept:
        live = [c for c in found[doc_id] if c[5] and not copied(c[4])]
        done, parts = 0, []
        for _, start, end, *_ in sorted(live, key=lambda c: c[1:3]):
            if end > done:
                parts += [text[done:start], "[secret]" if start >= done else ""]
                done = end
        out[doc_id] = "".join(parts) + text[done:] if live else text
    return out


def test_rows_equal_the_brute_force_version(spark, sf_dir):
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")  # the smallest table holds no live secret
    sf_dir = larger if os.path.isdir(larger) else sf_dir
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    left = brute_force(model, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert any("[secret]" in t for t in left.values()) or sf_dir != larger
    encoder = tokens.encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    want = set()
    for (doc_id, text), ids in zip(left.items(), encoder.encode_each([t or "" for t in left.values()])):
        ids = np.append(ids, [1]).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096].tobytes()
            want.add((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_stages_keep_the_columns(spark, sf_dir, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(set(names)) == 5
    for start, least in ((awkward(spark), 5), (empty(spark), 0)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if k < 4:
                assert out.columns == start.columns, name
            path = str(tmp_path / f"{least}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert (docs.count() > 0) == (least > 0)
