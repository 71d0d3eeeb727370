"""Language identification by rank-order profiles (operator 8).

Method: the n-grams (one to three characters, words padded with a blank) of a language's
training texts are ranked by frequency, and so are a document's own; the distance to a
language is the sum, over the document's most frequent n-grams, of how far each is out of
its place in the language's profile, and an n-gram it lacks costs the whole profile's length.

Profiles come from at most ``rows_a_language`` texts of each learned language (documented
bound; the rows with the smallest hash of their id), never from held-out ids. Every
text is identified whole, by its text alone, however long. Any number of languages is learnt: profiles are
a table, and texts are compared with up to some ``GROUP`` languages in one pass, the
nearest of all passes counts.

Defined results: `und` with score 0 for a null text, a text without a letter, or when
nothing was learnt; ties in frequency go to the shorter n-gram, then to the smaller code points, the
blank first; ties in distance to the smaller name; null languages and null ids teach nothing; repeated rows
get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfield.llm.common import fresh, held_out, located, settle

PROFILE = 400
ROWS_A_LANGUAGE = 4000
# Languages a pass compares with; a profile takes some 5 kB.
GROUP = 2000
# Ids of training texts up to which they are broadcast, some 40 bytes each.
FEW = 1_000_000
UNKNOWN = "und"
# The blank's own code; letters have larger ones.
BLANK = 1


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else the blank."""
    return np.fromiter((c if chr(c).isalpha() else BLANK for c in range(0x110000)), np.int32, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, counts): up to three codes of 21 bits each, the last lowest."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    chars = np.concatenate([[BLANK], _letters()[points], [BLANK]]).astype(np.int64)
    blank = chars == BLANK
    chars = chars[~(blank & np.append(False, blank[:-1]))]  # one blank for a run of them
    two = chars[:-1] << 21 | chars[1:]
    three = two[:-1] << 21 | chars[2:]
    grams = np.concatenate([chars[chars > BLANK], two, three[chars[1:-1] > BLANK]])
    return np.unique(grams, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent, the most frequent first."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass
class Profiles:
    """Of each known n-gram (``grams``, sorted) the languages that have it and its place there.

    Those of gram g stand at ``begin[g]`` to ``begin[g + 1]`` of ``lang`` and ``rank``.
    """

    names: list[str]
    grams: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    size: int

    @staticmethod
    def of(names: list[str], gram: np.ndarray, rank: np.ndarray, size: int) -> Profiles:
        """``names[i]`` has ``gram[i]`` at place ``rank[i]``, from 0."""
        known, lang = np.unique(np.array(names, object).astype(str), return_inverse=True)
        order = np.lexsort((lang, gram))
        grams, first = np.unique(gram[order], return_index=True)
        return Profiles(
            known.tolist(), grams, np.append(first, len(order)), lang[order].astype(np.int32), rank[order].astype(np.int32), size
        )

    def identify(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, distance): the score is how much nearer the best profile is than none at all."""
        grams, counts = ngrams(text)
        if not len(grams) or not (grams < 1 << 21).any() or not self.names:
            return UNKNOWN, 0.0, 0
        own = ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        begin, end = self.begin[at[place]], self.begin[at[place] + 1]
        many = end - begin
        entry = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        nearer = self.size - np.abs(self.rank[entry] - np.repeat(place, many))
        won = np.bincount(self.lang[entry], nearer, len(self.names))
        best = int(won.argmax())
        distance = self.size * len(own) - int(won[best])
        return self.names[best], 1 - distance / (self.size * len(own)), distance


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE,
    rows_a_language: int = ROWS_A_LANGUAGE,
) -> DataFrame:
    """(lang, gram, rank from 0) of the languages of ``docs``, written once."""
    usable = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    ).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # The bound as a limit on the hash: the share of rows that leaves about the wanted number,
    # then exact by rank among those, so no language is sorted as a whole.
    number = F.xxhash64(F.lit("profile"), "id")
    sizes = usable.groupBy("lang").count()
    share = F.least(F.lit(1.0), 2.0 * rows_a_language / F.col("count"))
    drawn = usable.select("id", "lang").distinct().withColumn("number", number).join(sizes, "lang")
    drawn = drawn.where(F.col("number") / 2.0**64 + 0.5 <= share)
    own = W.partitionBy("lang").orderBy("number", "id")
    chosen = drawn.withColumn("place", F.row_number().over(own)).where(F.col("place") <= rows_a_language)
    chosen = settle(chosen.select("id", "lang"), "chosen")
    if chosen.count() <= FEW:
        chosen = F.broadcast(chosen)
    # An id that many rows share teaches by one of them.
    texts = usable.join(chosen, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            text = batch.column(1).to_pylist()
            for name in sorted(set(lang)):
                found = [ngrams(text[i]) for i in np.flatnonzero(lang == name)]
                grams, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(total)], ["lang", "gram", "n"]
                )

    grams = (
        texts.select("lang", "text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size)
    return settle(top.select("lang", "gram", "rank"), "profiles")


def loaded(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    """The profiles of a table, to be sent to tasks: at most ``size`` rows a language."""
    found = profiles.select("lang", "gram", "rank").toArrow()
    return Profiles.of(
        found.column("lang").to_pylist(), found.column("gram").to_numpy(), found.column("rank").to_numpy(), size
    )


def language_column(text: Column, profiles: Profiles) -> Column:
    """struct(lang, score, distance) of each text."""

    @F.pandas_udf("lang string, score double, distance long")
    def named(texts):
        import pandas as pd

        return pd.DataFrame([profiles.identify(t) for t in texts], columns=["lang", "score", "distance"])

    return named(text)


def identify_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE,
    rows_a_language: int = ROWS_A_LANGUAGE,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    profiles = learn(docs, id_col, text_col, lang_col, size, rows_a_language)
    passes = max(1, -(-profiles.select("lang").distinct().count() // group))

    def found(rows: DataFrame, number: int) -> DataFrame:
        own = loaded(profiles.where(F.pmod(F.xxhash64("lang"), F.lit(passes)) == number), size)
        return rows.select(
            F.col(id_col).alias("doc_id"), *(F.col(c).alias(n) for c, n in place), language_column(F.col(text_col), own).alias("found")
        )

    place = []
    if passes == 1:
        nearest = found(docs, 0)
    else:
        file, row = fresh(docs, "at_file"), fresh(docs, "at_row")
        place, placed = [(file, "file"), (row, "row")], located(docs, file, row)
        each = [settle(found(placed, k), "languages") for k in range(passes)]
        rows = functools.reduce(DataFrame.unionByName, each)
        # A pass that learnt no language says nothing; texts without letters are unknown to all.
        order = F.struct((F.col("found.lang") == UNKNOWN).alias("none"), "found.distance", "found.lang", "found.score")
        nearest = rows.groupBy("file", "row").agg(F.any_value("doc_id").alias("doc_id"), F.min(order).alias("found"))
    return nearest.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score"
    )
