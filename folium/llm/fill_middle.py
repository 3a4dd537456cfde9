"""Fill-in-middle transformation by one numpy kernel over the Arrow buffers of many texts.

A table lookup classes every byte, a second one on the classes of adjacent bytes marks where a unit starts, and
cumulative sums of those marks (less their value at each document's start) number the units of each document. The
cuts of all documents are then found by one searchsorted. Code points are counted the same way. Bytes are only moved,
never decoded. What is held at once is 1 MB of texts, or one text.

Cuts, form and order depend on seed and id alone: on the 8-digit groups of sha256("seed:id").

Defined cases: a null text is empty and stays plain; a null id is hashed as an empty string; rows equal in id and
text give equal rows; a text that holds a sentinel stays plain; no rows give no rows. Columns asked for
by `keep` are carried on, unless a new column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folium.llm._text import Texts, texts

SENTINELS = ("<P>", "<S>", "<M>")
OTHER, SPACE, BREAK, INNER = range(4)  # classes of bytes; INNER: second and later bytes of a code point
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
CLASS[0x0A] = BREAK
CLASS[0x80:0xC0] = INNER


def _pairs(starts) -> np.ndarray:
    return np.array([starts(before, now) for before in range(4) for now in range(4)])


STARTS = {  # whether a unit starts between bytes of two classes
    "line": _pairs(lambda before, now: before == BREAK),
    "word": _pairs(lambda before, now: before in (SPACE, BREAK) and now == OTHER),
    "character": _pairs(lambda before, now: now != INNER),
}


def _upto(mask: np.ndarray) -> np.ndarray:
    """How many marks stand before each byte, and at the end."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, dtype=out.dtype, out=out[1:])
    return out


class Cuts:
    """The units of some texts. n: units of each; at(row numbers of units): byte offset of the end of so many units."""

    def __init__(self, part: Texts, unit: str):
        kind = CLASS[part.data]
        mark = np.empty(len(kind), bool)
        mark[1:] = STARTS[unit][kind[:-1] * 4 + kind[1:]]
        first = part.at[:-1][part.at[1:] > part.at[:-1]]
        mark[first] = True
        self.ends, self.upto, self.chars = part.at[1:], _upto(mark), _upto(kind != INNER)
        self.before = self.upto[part.at[:-1]].astype(np.int64)  # where the count starts anew
        self.n = self.upto[part.at[1:]] - self.before

    def at(self, units: np.ndarray) -> np.ndarray:
        """Byte offset after the first units[row] units of each row, for all rows together."""
        place = np.searchsorted(self.upto, self.before + units + 1, "left") - 1
        return np.where(units < self.n, place, self.ends)

    def points(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.chars[stop].astype(np.int64) - self.chars[start]


def _kernel(unit: str, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]):
    marks = [np.frombuffer(s.encode(), np.uint8) for s in sentinels]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_folium_text")
            odd = np.zeros(batch.num_rows, bool)
            for s in sentinels:
                odd |= pc.fill_null(pc.match_substring(text, s), False).to_numpy(zero_copy_only=False)
            draws = [batch.column(f"_folium_h{i}").to_numpy() for i in range(4)]
            kept = [i for i, c in enumerate(batch.schema.names) if not c.startswith("_folium_")]
            for row, part in texts(text, raw=True):
                rows = slice(row, row + part.rows)
                cuts, (h1, h2, h3, h4) = Cuts(part, unit), (h[rows] for h in draws)
                x, y = h1 % (cuts.n + 1), h2 % (cuts.n + 1)
                plain = odd[rows] | (part.at[1:] == part.at[:-1]) | (h3 % 100 >= fim_percent)
                spm = h4 % 100 < spm_percent
                a, d = part.at[:-1], part.at[1:]
                b, c = cuts.at(np.minimum(x, y)), cuts.at(np.maximum(x, y))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(row, part.rows) for i in kept],
                        pa.array(cuts.n.astype(np.int64)),
                        pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                        pa.array(cuts.points(a, b), mask=plain),
                        pa.array(cuts.points(b, c), mask=plain),
                        _output(part.data, a, b, c, d, plain, spm, marks),
                    ],
                    [*[batch.schema.names[i] for i in kept], "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return kernel


def _output(data, a, b, c, d, plain, spm, marks) -> pa.Array:
    """The texts rebuilt: slices of the old buffer and sentinels, put together once."""
    p, s, m = marks
    slices, size = [], np.where(plain, d - a, d - a + len(p) + len(s) + len(m))
    for i, j, k, n, as_is, suffix_first in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), plain.tolist(), spm.tolist()):
        if as_is:
            slices.append(data[i:n])
        elif suffix_first:
            slices += (s, data[k:n], p, data[i:j], m, data[j:k])
        else:
            slices += (p, data[i:j], s, data[k:n], m, data[j:k])
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.concatenate(slices) if slices else b""))


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS,
    keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id_col, the columns of keep, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars, output.

    unit: line, word or character. sentinels stand before prefix, suffix and middle.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [id_col, *[c for c in keep if c != id_col and c not in new]]
    draws = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_folium_h{i}") for i in range(4)]
    rows = docs.select(*kept, F.col(text_col).alias("_folium_text"), *draws)
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], "n long, form string, prefix_chars long, middle_chars long, output string"])
    return rows.mapInArrow(_kernel(unit, fim_percent, spm_percent, sentinels), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from output and form only. No piece holds a sentinel, nor can one arise where pieces meet."""
    p, s, m = sentinels

    def between(left: str, right: str | None) -> Column:
        start = F.locate(left, output) + len(left)
        stop = F.locate(right, output) if right else F.char_length(output) + 1
        return F.substring(output, start, stop - start)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
