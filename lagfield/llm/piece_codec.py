"""SentencePiece encoding and decoding (operator 2).

Method: an Aho-Corasick automaton over the vocabulary's pieces runs once over a text.
At each position its output links give every piece that ends there, and each relaxes
the best score of a segmentation that ends at that position (Viterbi), so one pass finds the
segmentation with the highest sum of piece scores. A character that no piece covers
becomes its UTF-8 bytes, at a score below that of any piece.

No piece goes on after a word's mark once letters have begun, so the best segmentation of a text is that
of its words, one after another. Arrow splits a batch of texts and numbers its words; the words a worker does
not remember go through the automaton one after another in a single run, and NumPy relaxes the
matches that end at the same place of all these words together. Longer words are segmented one by one, and
a vocabulary without that property has its texts segmented as a whole.

Ties take the longest last piece. Defined results: a null or empty text has no ids and
decodes to the empty text; repeated rows get a row each; a null id stays null; an empty
table gives no rows; other columns are not read. Texts are segmented whole, however long, in memory of a
text's size. Decoding restores a text exactly, except
that the mark itself (U+2581) comes back as a space.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.tokens import Remembered, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
# Words a worker remembers in one generation (it keeps two).
WORDS = 120_000
# Characters of text, and of words not remembered, that are handled together; longer words go alone.
BATCH_CHARS, JOINED_CHARS, LONGEST_JOINED = 2_000_000, 100_000, 64
# How far below the worst piece a character without a piece scores.
PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Codec:
    """Pieces, scores and byte fallback of one SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [
            i
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        if len(self.byte) != 256 or not plain:
            raise ValueError("the vocabulary has no byte fallback")
        self.score = {i: model.get_score(i) for i in plain}
        self.missing = min(self.score.values()) - PENALTY
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) for i in plain)
        self.words = Remembered(WORDS, self._segment)
        self.text_of = [None if i in self.value else p for i, p in enumerate(self.pieces)]
        # Pieces of one character by code point: where words go together they need no automaton.
        single = sorted((ord(self.pieces[i]), i) for i in plain if len(self.pieces[i]) == 1)
        self.letters, self.letter_ids = np.array([*single, (1 << 21, -1)]).T
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.scores = np.array([self.score.get(i, np.nan) for i in range(size)])
        self.spelled = pa.array([bytes([self.value[i]]) if i in self.value else p.encode() for i, p in enumerate(self.pieces)], pa.large_binary())

    def _automaton(self, least: int) -> ahocorasick.Automaton:
        """Over the pieces of ``least`` characters or more."""
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in self.score:
            if len(self.pieces[i]) >= least:
                out.add_word(self.pieces[i], i)
        out.make_automaton()
        return out

    # Built when first needed: decoding needs none, and many tables no words that go alone.
    automaton = functools.cached_property(lambda self: self._automaton(1))
    joined = functools.cached_property(lambda self: self._automaton(2))

    def _segment(self, text: str) -> tuple[bytes, float]:
        """(ids as little-endian 32-bit bytes, score) of the best segmentation."""
        best = [0.0] + [None] * len(text)
        back: list[tuple[int, int]] = [(0, -1)] * (len(text) + 1)

        def bridge(begin: int, end: int) -> None:
            # Positions that no piece reaches: the character before each falls back to bytes.
            for at in range(begin, end + 1):
                fallback = best[at - 1] + self.missing
                if best[at] is None or fallback > best[at]:
                    best[at], back[at] = fallback, (1, -1)

        done = 0  # positions up to here are final
        of = self.score
        for last, piece in self.automaton.iter(text):
            end, length, score = last + 1, len(self.pieces[piece]), of[piece]
            if end > done + 1:
                bridge(done + 1, end - 1)
                done = end - 1
            total = best[end - length] + score
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (length, piece)
        bridge(done + 1, len(text))
        ids, at = [], len(text)
        while at:
            length, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte[b] for b in reversed(text[at - 1].encode()))
            at -= length
        return np.array(ids[::-1], "<u4").tobytes(), best[len(text)]

    def _segment_joined(self, words: list[str]) -> list[tuple[bytes, float]]:
        """What ``_segment`` gives for each of these words, which all begin with the mark."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(sizes + 1) - sizes - 1  # a word has a place before each character and one behind
        end, text = base + sizes, "".join(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        # Each place but the first by its last character: a piece of its own, or its bytes (-1).
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.searchsorted(self.letters, chars)
        back, best = np.full(len(chars) + len(words), -1), np.zeros(len(chars) + len(words))
        here = np.arange(len(chars)) + 1 + owner
        back[here] = np.where(self.letters[at] == chars, self.letter_ids[at], -1)
        alone = np.where(back < 0, self.missing, self.scores[back])
        char = np.zeros(len(back), np.uint32)
        char[here] = chars
        # Longer pieces, by place in the word, then word; those that end together stay longest first, as they are found.
        matches = self.joined.iter(text) if len(self.joined) else ()
        found = np.fromiter(itertools.chain.from_iterable(matches), np.int64)
        last, piece = found[::2], found[1::2]
        to = last + 1 + owner[last]
        place = to - base[owner[last]]
        inside = self.lengths[piece] <= place  # trailing marks and the next word's can make up a piece
        to, piece, place = to[inside], piece[inside], place[inside]
        order = np.argsort(place.astype(np.int16), kind="stable")
        to, piece = to[order], piece[order]
        before, gain = to - self.lengths[piece], self.scores[piece]
        begins = np.searchsorted(place[order], np.arange(1, sizes.max() + 2))
        longest = np.argsort(-sizes, kind="stable")
        reach = np.searchsorted(-sizes[longest], -np.arange(1, sizes.max() + 1), side="right")
        for k in range(1, sizes.max() + 1):
            here = base[longest[: reach[k - 1]]] + k
            best[here] = best[here - 1] + alone[here]
            own = slice(begins[k - 1], begins[k])
            ends = to[own]
            if len(ends):
                total = best[before[own]] + gain[own]
                first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
                top = np.maximum.reduceat(total, first)
                equal = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, len(ends)))))
                equal = equal[np.append(True, ends[equal[1:]] != ends[equal[:-1]])]
                ends = ends[first]
                wins = top >= best[ends]  # the longer piece on ties
                best[ends[wins]], back[ends[wins]] = top[wins], piece[own][equal[wins]]
        # From the ends of all words back to their beginnings, a piece of each at a time.
        width = np.where(back < 0, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF), 1)
        length = np.where(back < 0, 1, self.lengths[back])
        word, here, steps, n_ids = np.arange(len(words)), end, [], np.zeros(len(words), np.int64)
        while len(word):
            n_ids[word] += width[here]
            steps.append((word, here, n_ids[word]))
            here = here - length[here]
            left = here > base[word]
            word, here = word[left], here[left]
        ids, stops = np.empty(n_ids.sum(), "<u4"), np.cumsum(n_ids)
        for word, here, used in steps:
            begin = stops[word] - used
            ids[begin] = back[here]
            spelled = back[here] < 0
            for c in set(char[here[spelled]].tolist()):
                own = begin[spelled & (char[here] == c)]
                for j, b in enumerate(chr(c).encode()):
                    ids[own + j] = self.byte[b]
        flat, stops = ids.tobytes(), (4 * stops).tolist()
        return list(zip([flat[a:b] for a, b in itertools.pairwise([0, *stops])], best[end].tolist()))

    def _segment_each(self, words: list[str]) -> list[tuple[bytes, float]]:
        """(ids, score) of each of these distinct words, remembered or segmented now."""
        recent, older = self.words.get, self.words.older.get
        made = [recent(w) or older(w) for w in words]
        group, chars = [], 0

        def join() -> None:
            for i, done in zip(group, self._segment_joined([words[i] for i in group]) if group else ()):
                made[i] = done
            group.clear()

        for i in [i for i, known in enumerate(made) if known is None]:
            if len(words[i]) > LONGEST_JOINED:
                made[i] = self._segment(words[i])
                continue
            group.append(i)
            chars += len(words[i])
            if chars >= JOINED_CHARS:
                join()
                chars = 0
        join()
        self.words.remember(words, made)
        return made

    def _words(self, texts: pa.Array) -> pa.Array:
        """The words of each text, each without the mark it begins with."""
        spaced = pc.replace_substring(texts, MARK, " ")
        lists = pc.split_pattern(spaced, " ")
        # Several marks in a row begin one word, and an empty text has none.
        runs = pc.or_(pc.match_substring(spaced, "  "), pc.starts_with(spaced, " "))
        uneven = np.flatnonzero(pc.or_(runs, pc.equal(spaced, "")).to_numpy(zero_copy_only=False))
        if len(uneven):
            own = [[w[1:] for w in _WORD.findall(MARK + t.replace(" ", MARK))] if t else [] for t in spaced.take(pa.array(uneven)).to_pylist()]
            place = np.arange(len(texts))
            place[uneven] = len(texts) + np.arange(len(uneven))
            lists = pa.concat_arrays([lists, pa.array(own, lists.type)]).take(pa.array(place))
        return lists

    def encode_texts(self, texts: pa.Array) -> tuple[bytes | pa.Buffer, np.ndarray, list[float]]:
        """(ids of all texts in a row, how many each text has, summed score of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            done = [self._segment(MARK + t.replace(" ", MARK)) if t else (b"", 0.0) for t in texts.to_pylist()]
            return b"".join([i for i, _ in done]), np.array([len(i) // 4 for i, _ in done], np.int64), [x for _, x in done]
        lists = self._words(texts)
        coded = pc.list_flatten(lists).dictionary_encode()
        made = self._segment_each([MARK + w for w in coded.dictionary.to_pylist()])
        # Arrow lays the ids of distinct words out again by text.
        laid = pa.array([ids for ids, _ in made], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64)
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        score = np.array([x for _, x in made])[coded.indices.to_numpy()].tolist() if made else []
        sums = [sum(score[a:b]) for a, b in itertools.pairwise(bounds.tolist())]
        return laid.buffers()[2] or b"", np.diff(ends[bounds]) // 4, sums

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Ids and summed score of a text; a space becomes the mark, and one goes in front."""
        ids, _, score = self.encode_texts(pa.array([text], pa.large_string()))
        return bytes(ids), float(score[0])

    def decode_texts(self, ids: pa.Array) -> pa.Array:
        """The text of each row's ids; null has the empty text."""
        ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        if len(ids) == 0 or bounds[-1] == bounds[0]:
            return pa.array([""] * len(ids), pa.string())
        if (np.diff(bounds) % 4).any():
            raise ValueError("ids are not whole 32-bit numbers")
        own = np.frombuffer(ids.buffers()[2], "<u4", (bounds[-1] - bounds[0]) // 4, bounds[0])
        spelled = self.spelled.take(pa.array(own))
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[(bounds - bounds[0]) // 4]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), spelled.buffers()[2]])
        try:
            texts = whole.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.decode(i) for i in ids.to_pylist()], pa.string())
        return pc.utf8_slice_codeunits(pc.replace_substring(texts, MARK, " "), 1).cast(pa.string())

    def decode(self, ids: bytes) -> str:
        text, of, value = [], self.text_of, self.value
        pending = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            piece = of[i]
            if piece is None:
                pending.append(value[i])
                continue
            if pending:
                text.append(pending.decode(errors="replace"))
                pending.clear()
            text.append(piece)
        text.append(pending.decode(errors="replace"))
        return "".join(text).replace(MARK, " ")[1:]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many together as the bound on characters allows, one at least."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy())
    begin = 0
    while begin < len(ends):
        limit = (ends[begin - 1] if begin else 0) + BATCH_CHARS
        end = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_ids and score of every row."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in itertools.chain.from_iterable(map(_pieces_of, batches)):
            ids, n_ids, score = own.encode_texts(batch.column(1))
            ends = (4 * np.append(0, np.cumsum(n_ids))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n_ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed, pa.array(n_ids, pa.int64()), pa.array(score, pa.float64())],
                ["doc_id", "ids", "n_ids", "score"],
            )

    return docs.select(id_col, text_col).mapInArrow(encode, f"doc_id {kind}, ids binary, n_ids long, score double")


def decode_column(ids: Column, vocabulary: str | None = None) -> Column:
    """The text that ids (little-endian unsigned 32-bit) stand for."""
    path = vocabulary or vocabulary_path(VOCABULARY)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return codec(path).decode_texts(column)

    return decoded(ids)
