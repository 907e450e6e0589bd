import re

import numpy as np
import pyarrow as pa

from headroom.llm.arrow import pieces
from headroom.llm.words import shingles_of, words_of

TEXTS = ["Ab cd, ef gh ij kl", None, "", "cd", "é à! 12", "ab cd ef gh ij", "x" * 5000 + " y", "..."]


def split(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def test_words_are_those_of_a_plain_split():
    words = words_of(pa.array(TEXTS))
    names = {}
    for i, text in enumerate(TEXTS):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]].tolist()
        plain = split(text)
        assert len(own) == len(plain)
        for h, w in zip(own, plain, strict=True):
            assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)


def test_shingles_equal_when_words_equal():
    shingles, bounds = shingles_of(words_of(pa.array(TEXTS)))
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 1, 1, 0]
    assert shingles[0] == shingles[bounds[5]]


def test_slices_see_only_their_texts():
    column = pa.array(TEXTS)
    whole = words_of(column)
    part = words_of(column.slice(3, 3))
    assert part.hashes.tolist() == whole.hashes[whole.bounds[3] : whole.bounds[6]].tolist()


def test_pieces_cover_all_rows_once():
    column = pa.array(["a" * n for n in (5, 50, 1, 1, 1, 200, 3)] + [None])
    cut = list(pieces(column, 20))
    assert [i for a, b in cut for i in range(a, b)] == list(range(8))
    assert list(pieces(pa.array([], pa.string()))) == []
