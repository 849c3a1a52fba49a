import random
import re
import tracemalloc

import pyarrow as pa

from msgflow.llm import winnow
from msgflow.llm.words import Words, pieces

from .helpers import UPPER


def cut(cutter, texts):
    column = pa.array(texts)
    first, starts, ends, hashes = cutter.cut(column)
    data = "".join(texts).encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    words = [data[a:z].decode() for a, z in zip(starts, ends)]
    return [words[a:z] for a, z in zip(first, first[1:])], hashes, words


def test_words_are_those_of_the_patterns():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB é0_ß-\n\t\x0b\x1cZ漢\0") for _ in range(rng.randrange(30))) for _ in range(500)] + ["", "", "x"]
    for separators, pattern in ((b" \t\n\v\f\r", r"[^\x20\x09-\x0D]+"),
                                (winnow.SEPARATORS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashes, flat = cut(Words(separators), texts)
        assert got == [re.findall(pattern, t.translate(UPPER)) for t in texts]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_slices_and_pieces():
    column = pa.array(["abc def", "", "x" * 50, "g", "h i"])
    assert list(pieces(column, 10)) == [(0, 2), (2, 3), (3, 5)]
    first, _, _, hashes = Words(b" ").cut(column.slice(3, 2))
    assert first.tolist() == [0, 1, 3]
    assert hashes[0] == Words(b" ").cut(pa.array(["g"]))[3][0]
    assert Words(b" ").cut(pa.array([], pa.string()))[0].tolist() == [0]


def test_a_piece_takes_little_memory():
    """A task of 2 cores has to share 3 GB with Spark's heap."""
    column = pa.array(["some words of one text " * 100] * 2000)
    tracemalloc.start()
    try:
        cutter = Words(b" ")
        for start, stop in pieces(column):
            cutter.cut(column.slice(start, stop - start))
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
