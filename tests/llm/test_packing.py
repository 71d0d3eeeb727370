"""Operators 3 and 9: tokens, pieces, sequences, binary rows."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagfield.llm import best_fit, packed_ids, tokens
from text_fixtures import TEXTS, awkward, empty, rows

PATH = tokens.vocabulary_path("word_bpe_49k.json")


def plain_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_tokenizer(name):
    path = tokens.vocabulary_path(name)
    texts = [t or "" for t in TEXTS[:12] + TEXTS[13:]]
    texts += ["  lead", "tail  ", "a\n\n b", "it's 've 12 3", "ǅ İ Σας ΌΣ ſ K", "é ́a", "<|ENDOFTEXT|>", "½ ² ªº _ x_y", "a.b, c."]
    for text, got in zip(texts, tokens.encoder(path).encode_each(texts)):
        assert got.tolist() == plain_ids(path, text), text[:60]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abE é'.,\n\t 1_½Σ漢", max_size=30), min_size=1, max_size=5))
def test_ids_of_random_texts(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokens.vocabulary_path(name)
        assert [x.tolist() for x in tokens.encoder(path).encode_each(texts)] == [plain_ids(path, t) for t in texts]


def test_words_are_merged_once_while_they_are_remembered():
    encoder, asked = tokens.Encoder(PATH), collections.Counter()

    def merged(word):
        asked[word] += 1
        return encoder._word(word)

    encoder.words.compute = merged
    letters, long = "abcdefghijklmnopqrstuvwxyz", "x" * 100_000
    texts = [" ".join(f"{a}{b}{c}{d}" for c in letters for d in letters[:10]) for a in letters for b in letters]
    first = [ids.tolist() for ids in encoder.encode_each(texts + [long])]
    assert [ids.tolist() for ids in encoder.encode_each(texts + [long])] == first
    assert first[5] == plain_ids(PATH, texts[5]) and first[-1] == plain_ids(PATH, long)
    # 175,760 words, each merged once; one that is long takes no room.
    assert asked.pop(long) == 2 and len(asked) == 175_760 and set(asked.values()) == {1}
    assert long not in encoder.words and len(encoder.words) + len(encoder.words.older) <= 2 * tokens.WORDS


def naive_best_fit(lengths, size, limit):
    free, out = {}, []
    for n in lengths:
        fits = [b for b in free if free[b] >= n]
        if fits:
            least = min(free[b] for b in fits)
            out.append(least)
            b = next(b for b in fits if free[b] == least)
        else:
            if len(free) == limit:
                del free[min(free, key=free.get)]
            b = len(out) + 10**6
            free[b] = size
            out.append(size)
        free[b] -= n
        if not free[b]:
            del free[b]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_bounded_best_fit_equals_the_naive_one(lengths, limit):
    bins = best_fit.BestFit(16, limit)
    placed = [bins.place(n) for n in lengths]
    assert [16 - at for _, at in placed] == naive_best_fit(lengths, 16, limit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_decreasing_equals_the_naive_one(lengths):
    lengths = sorted(lengths, reverse=True)
    placed = packed_ids.best_fit_decreasing(lengths, 32)
    assert [32 - at for _, at in placed] == naive_best_fit(lengths, 32, 10**9)


def check_packing(got, size):
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by_sequence


def test_documents_are_cut_and_packed(spark):
    size = 256
    got = best_fit.pack_documents(awkward(spark), size=size, group_bytes=20_000).collect()
    sequences = check_packing(got, size)
    want = collections.Counter()
    for doc_id, text, *_ in rows():
        ids = np.array(plain_ids(PATH, text) + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size].tobytes()
            want[(doc_id, k, at, len(part) // 4, zlib.crc32(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    least = -(-sum(r.length for r in got) // size)
    assert len(sequences) <= 1.2 * least + 3
    assert best_fit.pack_documents(empty(spark)).count() == 0


def test_packing_is_repeatable_and_close_to_full(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = best_fit.pack_documents(docs, with_ids=False).collect()
    again = best_fit.pack_documents(docs, with_ids=False).collect()
    assert sorted(got) == sorted(again)
    sequences = check_packing(got, 4096)
    assert len(sequences) <= 1.03 * sum(r.length for r in got) / 4096 + 1


def test_packed_rows_restore_every_document(spark):
    size = 128
    got = packed_ids.write_packed(awkward(spark), size=size, group_bytes=20_000).collect()
    parts = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert (ids[r.n_tokens :] == packed_ids.END_ID).all()
        assert r.position_resets == sorted({*r.cu_seqlens[:-1], *([r.n_tokens] if r.n_tokens < size else [])})
        place = packed_ids.positions(r.cu_seqlens, size)
        assert [i for i in range(size) if place[i] == 0] == r.position_resets
        for k, doc in enumerate(r.doc_ids):
            own = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
            parts[doc].append((r.pieces[k], r.starts[k], own))
    texts = collections.defaultdict(list)
    for doc_id, text, *_ in rows():
        texts[doc_id].append(plain_ids(PATH, text) + [packed_ids.END_ID])
    assert parts.keys() == texts.keys()
    for doc_id, wants in texts.items():
        if len({tuple(w) for w in wants}) == 1:
            for _, start, own in parts[doc_id]:
                assert wants[0][start : start + len(own)] == own
        assert sum(len(own) for *_, own in parts[doc_id]) == sum(map(len, wants))
    assert packed_ids.pack_rows(empty(spark)).count() == 0


def test_binary_rows_can_be_written_anywhere(spark, tmp_path):
    docs = awkward(spark).where(F.col("doc_id") < 9)
    back = packed_ids.write_packed(docs, str(tmp_path / "packed"), size=64)
    assert back.count() == packed_ids.digest_rows(back).count() > 0
