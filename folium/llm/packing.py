"""Best-fit packing by minimum bin slack.

Texts become token ids, end with end_id, and are cut where they are longer than a sequence. Only lengths decide how pieces are
packed, so the plan is made on how many pieces have each length: a bin takes the longest piece left, then a
bitset subset-sum over the lengths left (each as often as it is there) finds the fullest feasible combination for the
rest of the bin, and the combination is removed, as many times as the counts allow. What reaches the driver is one count for
each possible length, whatever the number of documents; the plan has a few rows for each length.

Each task numbers its pieces of each length; a running sum of counts over tasks turns these numbers into ranks
within a length, and the plan gives each range of ranks its sequences and offsets. No row waits for the rows of its length.

Words are tokenised once and remembered (at most REMEMBERED in a worker, then anew): the tokenizer's
pre-tokens never span white space, so the ids of a text are those of its words in order. A word of letters and final punctuation
is remembered as these two parts.

Defined cases: a null or empty text is one piece that holds end_id; null ids are kept; rows equal in id and text are packed each;
a text without white space is tokenised in one go; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folium.llm._store import cut
from folium.llm._text import texts

REMEMBERED = 400_000
CHUNK = 4 << 20  # bytes of one text that are split into words at once
BROADCAST_CELLS = 200_000
# letters up to U+00FF and final punctuation: two pre-tokens, whatever stands around them; else any other word
_LINES = re.compile(rb"(?m)^(?:((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)|(.+))$")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_END = b" "  # no word is a space
_workers: dict[tuple[str, int], "Words"] = {}


class _Numbered(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number

    def since(self, n: int) -> list[bytes]:
        return list(islice(reversed(self), len(self) - n))[::-1]


class _Parts(_Numbered):
    """Numbered strings and their ids. Number 0 is the empty string."""

    def __init__(self):
        super().__init__({b"": 0})
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, encode) -> None:
        """encode: strings -> (their ids in a row, how many each has)."""
        ids, size = encode(self.since(len(self.start)))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def gather(self, numbers: np.ndarray, size: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        """Puts the ids of parts, of given sizes, to given places."""
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + within] = self.pool[np.repeat(self.start[numbers], size) + within]


class Words(_Numbered):
    """Numbers words as they come; ids() gives the token ids of numbered words. A word is some letters, then something else; either may be empty."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)
        self.last[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.letters, self.others = _Parts(), _Parts()
        self.others[_END] = 1
        self.others.learn(lambda _: (np.array([self.end_id], np.uint32), np.ones(1, np.int64)))
        self[_END] = 0
        self.head, self.tail = np.zeros(1, np.int32), np.ones(1, np.int32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encode_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of one pre-token each, many as one text: the last id of a pre-token says so."""
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            found = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[found])
            sizes = np.diff(ends, prepend=-1)
            if len(ends) != len(some) or ends[-1] != len(found) - 1:  # a vocabulary without marks of word ends
                found, sizes = self._encode(some)
            ids.append(found)
            size.append(sizes)
        return np.concatenate(ids), np.concatenate(size)

    def learn(self) -> None:
        """Tokenises the words numbered since the last call."""
        new = self.since(len(self.head))
        split = _LINES.findall(b"\n".join(new))
        head = np.fromiter((self.letters[a.lower()] for a, _, _ in split), np.int32, len(new))
        tail = np.fromiter((self.others[b or c] for _, b, c in split), np.int32, len(new))
        self.letters.learn(self._encode_letters)
        self.others.learn(self._encode)
        self.head, self.tail = np.concatenate([self.head, head]), np.concatenate([self.tail, tail])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's end."""
        head, tail = self.head[numbers], self.tail[numbers]
        first, second = self.letters.size[head], self.others.size[tail]
        ends = np.cumsum(first + second)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        self.letters.gather(head, first, ends - second - first, out)
        self.others.gather(tail, second, ends - second, out)
        return out, ends


def _split(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    while len(raw) - at > CHUNK and (space := _SPACE.search(raw, at + CHUNK)):
        yield raw[at : space.start()].split()
        at = space.end()
    yield [*raw[at:].split(), _END]


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _workers.setdefault((path, end_id), None) or Words(path, end_id)
        _workers[path, end_id] = known
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for row, part in texts(batch.column("text"), raw=True):
                if len(known) > REMEMBERED:
                    known.forget()
                raw, numbers, words = part.data.tobytes(), [], np.zeros(part.rows, np.int64)
                for i in range(part.rows):
                    for some in _split(raw[part.at[i] : part.at[i + 1]]):
                        numbers.append(np.fromiter(map(known.__getitem__, some), np.int32, len(some)))
                        words[i] += len(some)
                known.learn()
                ids, ends = known.ids(np.concatenate(numbers))
                stop = ends[np.cumsum(words) - 1]
                total = np.diff(np.r_[0, stop])
                n = -(-total // capacity)
                of = np.repeat(np.arange(part.rows), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[of] - start)
                first = (stop - total)[of] + start
                bounds = list(zip(first.tolist(), (first + length).tolist()))
                raw_ids = [ids[a:b].astype("<u4").tobytes() for a, b in bounds]
                # pieces of one length in this task so far
                order = np.argsort(length, kind="stable")
                run = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0])
                within = np.arange(len(order)) - np.repeat(run, np.diff(np.r_[run, len(order)]))
                nth = np.empty(len(order), np.int64)
                nth[order] = within + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [
                    batch.column("id").take(pa.array(row + of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(x) for x in raw_ids], pa.int64()), pa.array(np.full(len(of), task, np.int32)), pa.array(nth),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw_ids, pa.binary())] if keep_ids else columns, [*names, "ids"] if keep_ids else names)

    return pieces


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination that fills room as far as any does, longer pieces first.

    Bit s of a set says whether s can be reached. counts are in descending order of length.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length, count in counts.items():
        if length > room:
            continue
        before, left, k = reach, min(count, room // length), 1
        steps.append((length, left, before))
        while left:
            k = min(k, left)
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        times = next(t for t in range(most + 1) if t * length <= best and before >> (best - t * length) & 1)
        if times:
            out.append((length, times))
            best -= times * length
    return out[::-1]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in a sequence, first sequence, first offset) from the pieces of each length."""
    left, used, rows, sequence = dict(sorted(counts.items(), reverse=True)), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = next(iter(left))
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        chosen = dict(fullest(rest, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += n * k
        sequence += times
    return sorted(rows)


def _placed(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(rows, np.int64).reshape(-1, 6)
    length, first, _, each, sequence, offset = table.T
    begins = np.searchsorted(length, np.arange(length.max() + 2 if len(length) else 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for own in np.unique(n):
                lo, hi, here = begins[own], begins[own + 1], n == own
                at[here] = lo + np.searchsorted(first[lo:hi], rank[here], "right") - 1
            nth = rank - first[at]
            kept = [c for c in batch.schema.names if c != "rank"]
            placed_at = [pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *placed_at], [*kept, "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also ids (32-bit, little-endian).

    tokenizer: path of a tokenizer file that every worker has, whose pre-tokens do not span white space.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ids = ", ids binary" if keep_ids else ""
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long{ids}")
    pieces = cut(pieces, "pack-pieces")
    cells = cut(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(cells.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_CELLS else bases
    ranked = pieces.join(bases, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("base") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(_placed(plan(counts, capacity)), f"id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (32-bit, little-endian) and length of each sequence; packed: of pack(..., keep_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # bounded by the capacity
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", ids.alias("ids"), (F.octet_length(ids) / 4).cast("long").alias("length"))
