"""Operators 2 and 4."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagfield.llm import piece_codec, shards
from text_fixtures import TEXTS, awkward, empty, rows

PATH = piece_codec.vocabulary_path(piece_codec.VOCABULARY)


def brute_force(codec, text):
    """Best score and ids over all segmentations, position by position."""
    text = piece_codec.MARK + text.replace(" ", piece_codec.MARK)
    of = {codec.pieces[i]: i for i in codec.score}
    longest = max(map(len, of))
    best, ids = [0.0], [[]]
    for end in range(1, len(text) + 1):
        score, own = None, None
        for begin in range(max(0, end - longest), end):  # the longest last piece first
            i = of.get(text[begin:end])
            if i is not None and (score is None or best[begin] + codec.score[i] > score):
                score, own = best[begin] + codec.score[i], ids[begin] + [i]
        if score is None:
            score = best[-1] + codec.missing
            own = ids[-1] + [codec.byte[b] for b in text[end - 1].encode()]
        best.append(score)
        ids.append(own)
    return ids[-1], best[-1]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="theanr ing 漢🙂▁\n\tZ", max_size=24))
def test_viterbi_equals_brute_force(text):
    codec = piece_codec.codec(PATH)
    ids, score = codec.encode(text)
    if text:
        want, best = brute_force(codec, text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert math.isclose(score, best, rel_tol=1e-9, abs_tol=1e-6)
    assert codec.decode(ids) == text.replace(piece_codec.MARK, " ")


def test_words_and_whole_texts_agree():
    codec = piece_codec.codec(PATH)
    assert codec.by_word
    for text in [t for t in TEXTS if t][:12]:
        whole, _ = codec._segment(piece_codec.MARK + text.replace(" ", piece_codec.MARK))
        assert codec.encode(text)[0] == whole


def plain(codec, text):
    """Ids and score of a text, word by word."""
    words = piece_codec._WORD.findall(piece_codec.MARK + text.replace(" ", piece_codec.MARK)) if text else []
    done = [codec._segment(w) for w in words]
    return b"".join([i for i, _ in done]), float(sum([x for _, x in done]))


ODD = ["", " ", "  ", "a ", "a  ", "  a", " ▁ the▁▁", "the\n\nthe. \x00\x7f", "漢🙂é\u0301 ﷺ🙂", "▁", "the " * 90, "x" * 65, "ab" * 500 + " ab"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(ODD), st.text(max_size=30), st.text(alphabet="theanr ing 漢🙂▁\n\t.Z", max_size=60)), max_size=12))
def test_batches_equal_single_words(texts):
    codec = piece_codec.Codec(PATH) if not texts else piece_codec.codec(PATH)
    ids, n_ids, score = codec.encode_texts(pa.array(["left out", *texts], pa.string())[1:])
    ends = 4 * np.append(0, np.cumsum(n_ids))
    cut = [bytes(ids)[a:b] for a, b in zip(ends, ends[1:])]
    assert list(zip(cut, map(float, score))) == [plain(codec, t) for t in texts]
    back = codec.decode_texts(pa.array([b"1234", None, *cut], pa.binary())[1:]).to_pylist()
    assert back == ["", *[(t or "").replace(piece_codec.MARK, " ") for t in texts]]


def test_words_of_a_batch_go_through_the_automaton_together(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice([*"etaoinshr.\né漢"], rng.integers(1, 12))) for _ in range(40)) for _ in range(500)]
    want = [plain(piece_codec.codec(PATH), t) for t in texts]
    codec = piece_codec.Codec(PATH)
    runs = []
    monkeypatch.setattr(codec, "_segment", None)
    joined = codec._segment_joined
    monkeypatch.setattr(codec, "_segment_joined", lambda words: runs.append(len(words)) or joined(words))
    for _ in range(2):  # the second time all words are remembered
        ids, n_ids, score = codec.encode_texts(pa.array(texts))
        assert bytes(ids) == b"".join([i for i, _ in want]) and score == [x for _, x in want]
    assert len(runs) < 10 and sum(runs) == len({w for t in texts for w in t.split(" ")})


def test_ids_that_are_no_text():
    codec = piece_codec.codec(PATH)
    the = np.frombuffer(codec.encode("the")[0], "<u4").tolist()
    rows = [[*the, codec.byte[0xE2]], [codec.byte[0x96], *the], [codec.byte[b] for b in b"x\xe2\x96\x81y"], the]
    ids = pa.array([np.array(r, "<u4").tobytes() for r in rows], pa.binary())
    assert codec.decode_texts(ids).to_pylist() == [codec.decode(i) for i in ids.to_pylist()] == ["the\ufffd", " the", " y", "the"]
    assert codec.decode_texts(ids[2:]).to_pylist() == [" y", "the"]
    with pytest.raises(ValueError):
        codec.decode_texts(pa.array([b"123"]))
    with pytest.raises(IndexError):
        codec.decode_texts(pa.array([b"\xff\xff\xff\x7f"]))


def test_a_long_batch_is_cut_between_rows(monkeypatch):
    monkeypatch.setattr(piece_codec, "BATCH_CHARS", 10)
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 4, "b" * 6, None, "c" * 30, "", "d", "e" * 10])], ["doc_id", "text"])
    cut = [b.column(0).to_pylist() for b in piece_codec._pieces_of(batch)]
    assert cut == [[0, 1, 2], [3], [4, 5], [6]]


def test_documents_come_back_exactly(spark):
    got = piece_codec.encode_documents(awkward(spark)).withColumn("back", piece_codec.decode_column(F.col("ids")))
    want = collections.Counter((i, (t or "").replace(piece_codec.MARK, " ")) for i, t, *_ in rows())
    assert collections.Counter((r.doc_id, r.back) for r in got.collect()) == want
    assert piece_codec.encode_documents(empty(spark)).count() == 0


def python_shard(key, weights):
    def score(i):
        text = f"{'null' if key is None else key}:{i}"
        u = (int(hashlib.md5(text.encode()).hexdigest()[: shards.DIGITS], 16) + 1) / (16**shards.DIGITS + 1)
        return math.log(u) / weights[i]

    return max(range(len(weights)), key=lambda i: (score(i), i))


def test_shards_equal_the_rule_and_slots_are_gapless(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    got = shards.shard_documents(awkward(spark), weights=weights).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows()
    )
    slots = collections.defaultdict(list)
    for r in got:
        assert r.shard == python_shard(r.doc_id, weights)
        assert r.grown_shard == python_shard(r.doc_id, [*weights, 1.0])
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard_documents(empty(spark)).count() == 0


def test_few_rows_move_and_weights_are_shares(spark):
    keys = spark.range(20_000).withColumn("text", F.lit("x"))
    got = shards.shard_documents(keys, id_col="id", weights=[1.0] * 9 + [3.0]).collect()
    count = collections.Counter(r.shard for r in got)
    assert abs(count[9] / 20_000 - 0.25) < 0.02
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {10} and abs(len(moved) / 20_000 - 1 / 13) < 0.01


def test_a_hot_key_gets_slots_from_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 50)
    hot = spark.range(1000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    got = shards.shard_documents(hot).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(1000))
