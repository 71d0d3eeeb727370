"""Token ids of whole texts, merged once for each distinct word of a batch.

Both BPE vocabularies split a text into words before they merge anything, so a text's
ids are the ids of its space-separated chunks, one after another. A batch of texts is
split and its chunks numbered by Arrow, each distinct chunk is turned into ids, and
the ids are laid out again by NumPy. Whatever this does not cover (code points beyond
Latin-1, marks of special tokens, runs of white space where the vocabulary keeps
spaces) is given to the tokenizer as it is.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words a worker remembers in one generation (it keeps two), about 200 bytes each; longer ones are not remembered.
WORDS, LONGEST = 240_000, 32
# Code points of text that are numbered together.
BATCH_CHARS = 2_000_000


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte.

    Printable Latin-1 bytes stand for themselves; the rest take letters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def latin(text: str) -> bool:
    """Code points up to 255 only: composed already, and lower-cased one for one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _latin_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


_LETTER, _DIGIT, _SPACE = _latin_class("L"), _latin_class("N"), r"\t-\r\x20\x85\xa0"
# How each vocabulary splits text into words, as its file states it (here for Latin-1 text).
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+"
BYTE_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# A space beside white space or at an end belongs to no single word.
_UNEVEN_SPACE = re.compile(r" \s|\s |^ | $")


class Remembered(dict):
    """Values computed on demand; those not asked for through a whole generation are forgotten.

    Keys longer than ``longest`` are computed whenever they are asked for, so entries stay small.
    """

    def __init__(self, size: int, compute: Callable, longest: int = sys.maxsize):
        self.size, self.older, self.compute, self.longest = size, {}, compute, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self._room()
        self[key] = value
        return value

    def _room(self) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()

    def remember(self, keys: list, values: list, step: int = 4096) -> None:
        """Many values at once; a generation grows by less than ``step`` beyond its size."""
        for begin in range(0, len(keys), step):
            self._room()
            self.update(zip(keys[begin : begin + step], values[begin : begin + step]))


class Encoder:
    """Ids of texts, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = self.tokenizer.normalizer is None
        self.split = re.compile(BYTE_PATTERN if self.keeps_space else WORD_PATTERN).findall
        self.letters = byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.words = Remembered(WORDS, self._word, LONGEST)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not latin(chunk):
            return self._whole(chunk)
        return b"".join(map(self.words.__getitem__, self.split(chunk if self.keeps_space else chunk.lower())))

    def _chunks(self, chunks: list[str], space: str) -> list[bytes]:
        """Ids of each chunk; words with or without a final stop are looked up without a pattern."""
        if not latin("".join(chunks)):
            return [self._chunk(space + c) for c in chunks]
        words, made = self.words, []
        for c in chunks:
            if c.isalpha():
                made.append(words[space + (c if space else c.lower())])
            elif c[-1:] in (",", ".") and (head := c[:-1]).isalpha():
                made.append(words[space + (head if space else head.lower())] + words[c[-1]])
            else:
                made.append(self._chunk(space + c))
        return made

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last one ends)."""
        if self.keeps_space:
            whole = {i: t for i, t in enumerate(texts) if _UNEVEN_SPACE.search(t)}
            texts = ["" if i in whole else t for i, t in enumerate(texts)] if whole else texts
        else:
            whole = {}
            texts = [t.lower() if "<|" not in t and latin(t) else t for t in texts]
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begins = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.keeps_space:
            # The first chunk of a text has no space before it; a text left out above has one here, empty.
            firsts = [whole.get(i) for i in range(len(texts))]
            plain = np.append(codes[begins[:-1]], 0)
            made = self._chunks(chunks, " ")
            made += [self._chunk(chunks[plain[i]]) if w is None else self._whole(w) for i, w in enumerate(firsts)]
            codes = codes.copy()
            codes[begins[:-1]] = len(chunks) + np.arange(len(texts))
        else:
            made = self._chunks(chunks, "")
        flat = np.frombuffer(b"".join(made), "<u4")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        starts = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[codes])
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(starts[codes] - (ends - sizes[codes]), sizes[codes])
        return flat[at], np.concatenate([[0], ends])[begins]

    def encode_each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, numbering as many texts together as the batch bound allows."""
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            ids, at = self.encode(texts[begin:end])
            for i in range(end - begin):
                yield ids[at[i] : at[i + 1]]
            begin = end


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    return Encoder(path)
