"""Operator 10 on texts of which a part is junk."""

import random
import string

from lagfield.llm.quality import Bands

DRAW = random.Random(7)
LETTERS, WEIGHTS = "etaoinshrdlcumwfgypb", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 2, 1]
LEXICON = ["".join(DRAW.choices(LETTERS, WEIGHTS, k=DRAW.randint(2, 9))) for _ in range(600)]
BASE64 = string.ascii_letters + string.digits + "+/"


def prose(n):
    words = []
    while sum(map(len, words)) + len(words) <= n:
        words.append(DRAW.choice(LEXICON))
    return " ".join(words)[:n]


def test_junk_halves_and_tails_are_rejected():
    bands = Bands()
    for n in (700, 1500, 3000, 3500, 20_000, 100_000):
        text = prose(n)
        assert bands.judge(text)[3], n
        for share in (0.4, 0.5):
            k = round(n * share)
            for junk in (("buy now " * n)[:k], "".join(DRAW.choice(BASE64) for _ in range(k))):
                for planted in (text[: n - k] + junk, junk + text[k:]):
                    assert not bands.judge(planted)[3], (n, share, junk[:20])


def test_less_junk_is_allowed_in_long_texts():
    bands, n = Bands(), 100_000
    text = prose(n)
    for junk in ("buy now " * (n // 80), "".join(DRAW.choice(BASE64) for _ in range(n // 10))):
        assert not bands.judge(text[: n - n // 10] + junk)[3]
    assert bands.judge(text[: n - 300] + "".join(DRAW.choice(BASE64) for _ in range(300)))[3]


def test_every_byte_is_in_a_chunk():
    bands = Bands()
    assert [bands.judge(prose(n))[1] for n in (0, 100, 300, 600, 2500)] == [1, 1, 3, 3, 10 + 3]
