"""Operator 9: ids wider than 16 bits."""

import numpy as np
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from lagfield.llm import best_fit, packed_ids


def test_an_id_that_does_not_fit_is_an_error(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    with pytest.raises(Exception, match="id 70000 does not fit"):
        best_fit.cut(docs, end_id=70_000, kind_of_id="<u2").collect()
    assert best_fit.cut(docs, end_id=70_000).collect()[0].ids.endswith((70_000).to_bytes(4, "little"))


def test_a_vocabulary_of_70000_entries_gets_32_bits(spark, tmp_path):
    letters = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    filler = {f"<{i}>": i for i in range(26, 69_998)}
    made = Tokenizer(models.BPE(vocab=letters | filler | {"on": 69_998, "tw": 69_999}, merges=[("o", "n"), ("t", "w")]))
    made.normalizer, made.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    path = str(tmp_path / "large.json")
    made.save(path)
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    row = packed_ids.pack_rows(docs, size=8, end_id=5, vocabulary=path).collect()
    assert len(row) == 1 and len(row[0].ids) == 32
    ids = np.frombuffer(row[0].ids, "<u4").tolist()
    assert sorted(ids) == sorted([69_998, 4, 69_999, 14, 5, 5, 5, 5]) and row[0].n_tokens == 6
    assert packed_ids.kind_of_id(None, packed_ids.END_ID) == "<u2" and packed_ids.kind_of_id(None, 70_000) == "<u4"
