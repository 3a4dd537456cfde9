import numpy as np
import pyarrow as pa

from folium.llm import _text


def test_words_and_rows_match_plain_python():
    values = ["One  two\tthree", None, "", " x ", "é ü\n漢字 word", "a\x0bb\x0cc", "tail"]
    seen = {}
    for most in (1, 12, 1 << 20):
        got = []
        for row, part in _text.texts(pa.array(values), most):
            part.words()
            for i in range(part.rows):
                span = slice(part.word_at[i], part.word_at[i + 1])
                words = [part.data[a:b].tobytes() for a, b in zip(part.starts[span], part.ends[span])]
                got.append(words)
                for w, h in zip(words, part.hashes[span]):
                    assert seen.setdefault(w, h) == h
        assert got == [(v or "").encode().lower().split() for v in values]
    assert len(set(seen.values())) == len(seen)


def test_shingles_have_order_and_length():
    h = _text.mix(np.arange(10, dtype=np.uint64))
    assert len(_text.shingles(h, 4)) == 7
    assert len(_text.shingles(h[:2], 4)) == 1
    assert len(_text.shingles(h[:0], 4)) == 0
    assert _text.shingles(h[:2], 4)[0] != _text.shingles(h[1::-1], 4)[0]
