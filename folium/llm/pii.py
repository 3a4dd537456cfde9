"""Personal data: base patterns, and a character BiLSTM-CRF trained in numpy from labelled spans.

A span of any kind holds a digit or an @, so only stretches of text around those characters are looked at;
they are found over whole texts. The base spans come from patterns on the text. A bidirectional LSTM
reads overlapping windows of the stretches one character at a time and a linear-chain CRF scores tags B and
I of each kind and O. Per-character scores of overlapping windows are averaged into one
sequence for each stretch (each window counts most in its middle), and one Viterbi path is
decoded over the whole stretch, so a span across windows is one span. Stretches longer than BLOCK characters
are decoded in blocks that overlap by more than a span can be long, each giving the tags of its middle. Decoded spans that overlap no base span and hold what their kind
must (an @, enough digits) are added.

The model is trained on the spot: labelled spans are the base spans of a bounded sample of rows
and made-up sentences that set values of each kind, also with spaces and words between, into text.

Defined cases: a null text is empty; every row gives one row, repeated ones too; offsets count code points,
end exclusive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # as given, but tried once for each run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE, MARGIN = 64, 32, 40
BLOCK, OVERLAP, HELD = 2_048, 128, 1 << 17  # characters: decoded at once, read beyond a block, held at once
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
CLASSES = 40
HIDDEN, EMBED = 20, 12
SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, looked for only where an @ lets one be: at the start of the run of characters before it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in _LOCAL):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            found.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [("email", *s) for s in _emails(text)]
    if SIGN.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            found += [(kind, *m.span()) for m in pattern.finditer(text) if _passes(kind, m.group())]
    return found


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within MARGIN of a digit or @, merged."""
    found: list[list[int]] = []
    for m in SIGN.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.start() + MARGIN + 1)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def _classes() -> dict[str, int]:
    """Character classes: each sign of its own, letters by case and place in the alphabet's thirds, digits by value."""
    signs = "@.+-_%() \n\t,:;/|#'\""
    table = {c: i + 1 for i, c in enumerate(signs)}
    table |= {c: 22 + i for i, c in enumerate("0123456789")}
    for i in range(26):
        table[chr(97 + i)], table[chr(65 + i)] = 32 + i // 9, 35 + i // 9
    return table


_TABLE = np.zeros(128, np.int64)
for _c, _i in _classes().items():
    _TABLE[ord(_c)] = _i


def characters(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], 38)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """The network: embedding, LSTM in both directions, tag scores, CRF transitions."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"E": draw.normal(0, 0.3, (CLASSES, EMBED))}
        for d in "fb":
            self.w |= {f"W{d}": draw.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN)), f"c{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
        self.w |= {"O": draw.normal(0, 0.25, (2 * HIDDEN, TAGS)), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: windows x characters x EMBED. Hidden states, and what the way back needs."""
        n, length, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, length, HIDDEN), np.float32)
        kept = []
        w, bias = self.w[f"W{d}"], self.w[f"c{d}"]
        from_x = x.reshape(-1, EMBED) @ w[:EMBED] + bias
        from_x = from_x.reshape(n, length, -1)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = from_x[:, t] + h @ w[EMBED:]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before, prior = h, c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                kept.append((t, i, f, o, u, prior, tc, before))
        return out, kept

    def scores(self, chars: np.ndarray) -> np.ndarray:
        x = self.w["E"][chars]
        h = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return h @ self.w["O"] + self.w["o"]

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags per window, and its derivatives."""
        x = self.w["E"][chars]
        (hf, kf), (hb, kb) = self._run(x, "f", True), self._run(x, "b", True)
        h = np.concatenate([hf, hb], axis=2)
        score = h @ self.w["O"] + self.w["o"]
        n, length, _ = score.shape
        loss, d_score, d_t, d_s = self._crf(score, tags)
        g = {"T": d_t, "s": d_s, "O": np.einsum("ntj,ntk->jk", h, d_score), "o": d_score.sum((0, 1))}
        d_h = d_score @ self.w["O"].T
        d_x = np.zeros_like(x)
        for d, kept, part in (("f", kf, d_h[:, :, :HIDDEN]), ("b", kb, d_h[:, :, HIDDEN:])):
            w = self.w[f"W{d}"]
            dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, u, prior, tc, before in reversed(kept):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * u * i * (1 - i), dc * prior * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
                dw[:EMBED] += x[:, t].T @ dz
                dw[EMBED:] += before.T @ dz
                db += dz.sum(0)
                d_x[:, t] += dz @ w[:EMBED].T
                dh, dc = dz @ w[EMBED:].T, dc * f
            g |= {f"W{d}": dw, f"c{d}": db}
        g["E"] = np.zeros_like(self.w["E"])
        np.add.at(g["E"], chars.ravel(), d_x.reshape(-1, EMBED))
        return loss / n, {k: v / n for k, v in g.items()}

    def _crf(self, score: np.ndarray, tags: np.ndarray):
        n, length, _ = score.shape
        trans, start = self.w["T"], self.w["s"]
        alpha = np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + start
        for t in range(1, length):
            alpha[:, t] = _log_sum(alpha[:, t - 1][:, :, None] + trans[None], 1) + score[:, t]
        total = _log_sum(alpha[:, -1], 1)
        beta = np.zeros_like(score)
        d_t = np.zeros_like(trans)
        for t in range(length - 2, -1, -1):
            ahead = (score[:, t + 1] + beta[:, t + 1])[:, None, :] + trans[None]
            beta[:, t] = _log_sum(ahead, 2)
            d_t += np.exp(alpha[:, t][:, :, None] + ahead - total[:, None, None]).sum(0)
        p = np.exp(alpha + beta - total[:, None, None])
        rows = np.arange(n)
        gold = start[tags[:, 0]] + score[rows[:, None], np.arange(length)[None], tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        d_s = p[:, 0].sum(0)
        np.add.at(d_s, tags[:, 0], -1.0)
        np.add.at(d_t, (tags[:, :-1], tags[:, 1:]), -1.0)
        p[rows[:, None], np.arange(length)[None], tags] -= 1.0
        return float((total - gold).sum()), p, d_t, d_s

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> "Tagger":
        draw = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = draw.integers(0, len(chars), batch)
            _, g = self.gradient(chars[some], tags[some])
            now = np.float32(rate * min(1.0, 2.0 * (1 - step / (steps + 1))))
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each sequence of scores."""
        lens = np.array([len(x) for x in scores])
        most = int(lens.max())
        all_scores = np.zeros((len(scores), most, TAGS), np.float32)
        for i, x in enumerate(scores):
            all_scores[i, : len(x)] = x
        back = np.zeros((most, len(scores), TAGS), np.int8)
        best = all_scores[:, 0] + self.w["s"]
        last = np.where(lens == 1, best.argmax(1), 0)
        for t in range(1, most):
            ways = best[:, :, None] + self.w["T"]
            back[t] = ways.argmax(1)
            best = ways.max(1) + all_scores[:, t]
            last = np.where(lens == t + 1, best.argmax(1), last)
        tags = np.zeros((len(scores), most), np.int8)
        rows = np.arange(len(scores))
        now = last
        for t in range(most - 1, -1, -1):
            now = np.where(lens == t + 1, last, now)
            tags[:, t] = now
            now = back[t][rows, now]
        return [x[:n] for x, n in zip(tags, lens, strict=True)]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


# ---- labelled spans


def made_up(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with values of known places; also numbers that are nobody's."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4)))
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))

    def value(kind: str) -> str:
        if kind == "email":
            at = draw.choice(("@", "@", "@", " @ ", "(at)@"))
            return f"{word()}{draw.choice(('.', '_', '', '-'))}{word()}{draw.choice(('', digits(2)))}{at}{word()}.{draw.choice(('com', 'org', 'net', 'de', 'example'))}"
        if kind == "ip":
            return draw.choice((".", ".", ".", " . ")).join(str(draw.randint(0, 255)) for _ in range(4))
        if kind == "card":
            body = draw.choice("3456") + digits(14)
            number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
            sep = draw.choice((" ", "-", "", "  "))
            return sep.join(number[i : i + 4] for i in range(0, 16, 4))
        sep = draw.choice((" ", "-", " ", "."))
        plus = draw.choice(("+", "+", "00", ""))
        return f"{plus}{draw.randint(1, 99)}{sep}{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(draw.randint(0, 9))), []
        for _ in range(draw.randint(1, 2)):
            kind = draw.choice((*KINDS, None))
            text += draw.choice((" ", ": ", " (", "\n", ", "))
            start = len(text)
            if kind:
                text += value(kind)
                spans.append((kind, start, len(text)))
            else:
                text += draw.choice((digits(draw.randint(1, 6)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}"))
            text += draw.choice((" ", ".", ", ", ")", "\n")) + " ".join(word() for _ in range(draw.randint(0, 6)))
        out.append((text, spans))
    return out


def windows_of(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of equal length; ends are filled with class 0, tagged O."""
    chars, tags = [], []
    for text, spans in examples:
        c, t = characters(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            t[a:b] = k + 1
            t[a] = k
        for a, b in stretches(text):
            for s in range(a, max(a + 1, b - STRIDE), STRIDE):
                w = slice(s, min(b, s + WINDOW))
                chars.append(np.pad(c[w], (0, WINDOW - len(c[w]))))
                tags.append(np.pad(t[w], (0, WINDOW - len(t[w]))))
    return np.array(chars, np.int64).reshape(-1, WINDOW), np.array(tags, np.int64).reshape(-1, WINDOW)


def train(sample: list[str], seed: int = 3, steps: int = 220, batch: int = 48) -> Tagger:
    examples = made_up(1500, seed) + [(t[a:b], [(k, s - a, e - a) for k, s, e in base_spans(t) if a <= s and e <= b]) for t in sample for a, b in stretches(t)]
    chars, tags = windows_of(examples)
    return Tagger(seed).fit(chars, tags, steps, batch, 0.02, seed)


_BLEND = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)


def _tags(tagger: Tagger, pieces: list[str]) -> list[np.ndarray]:
    """Tags of each piece, from one path over the blended scores of its windows."""
    jobs, chars = [], []
    for i, text in enumerate(pieces):
        c = characters(text)
        for s in range(0, max(1, len(c) - STRIDE), STRIDE):
            jobs.append((i, s))
            chars.append(np.pad(c[s : s + WINDOW], (0, max(0, WINDOW - len(c[s : s + WINDOW])))))
    total = [np.zeros((len(t), TAGS)) for t in pieces]
    weight = [np.zeros(len(t)) for t in pieces]
    for at in range(0, len(jobs), 512):
        score = tagger.scores(np.array(chars[at : at + 512]))
        for (i, s), own in zip(jobs[at : at + 512], score, strict=True):
            n = min(WINDOW, len(pieces[i]) - s)
            total[i][s : s + n] += own[:n] * _BLEND[:n, None]
            weight[i][s : s + n] += _BLEND[:n]
    blended = [score / w[:, None] for score, w in zip(total, weight, strict=True)]
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))  # those of like length together
    for at in range(0, len(order), 64):
        some = order[at : at + 64]
        for i, tags in zip(some, tagger.decode([blended[i] for i in some]), strict=True):
            out[i] = tags
    return out


def model_spans(tagger: Tagger, parts: list[str]) -> list[list[tuple[str, int, int]]]:
    """For each stretch its spans."""
    tags = [np.zeros(len(t), np.int8) for t in parts]
    held, size = [], 0

    def settle() -> None:
        found = _tags(tagger, [parts[i][max(0, a - OVERLAP) : b + OVERLAP] for i, a, b in held])
        for (i, a, b), own in zip(held, found, strict=True):
            skip = a - max(0, a - OVERLAP)
            tags[i][a:b] = own[skip : skip + b - a]

    for i, text in enumerate(parts):
        for a in range(0, len(text), BLOCK):
            b = min(len(text), a + BLOCK)
            held.append((i, a, b))
            size += b - a + 2 * OVERLAP
            if size > HELD:
                settle()
                held, size = [], 0
    if held:
        settle()
    out = []
    for own in tags:
        spans, start, kind = [], -1, -1
        some = np.flatnonzero(own)
        for p in sorted({*some.tolist(), *(some + 1).tolist()}):
            t = int(own[p]) if p < len(own) else 0
            k = (t - 1) // 2 if t else -1
            if start >= 0 and (k != kind or t % 2 == 1):
                spans.append((KINDS[kind], start, p))
                start = -1
            if start < 0 and k >= 0:
                start, kind = p, k
        out.append(spans)
    return out


def _plausible(kind: str, found: str) -> bool:
    digits = sum(c in "0123456789" for c in found)
    if kind == "email":
        return "@" in found and "." in found.split("@")[-1] and len(found) >= 6 and found.split("@")[0].strip() != ""
    if kind == "ip":
        return _passes("ip", re.sub(r"\s", "", found)) if re.fullmatch(r"\s*\d+(\s*\.\s*\d+){3}\s*", found) else False
    if not re.fullmatch(r"[+(]?[0-9][0-9 ().+/-]*[0-9]", found):
        return False
    if kind == "card":
        return 13 <= digits <= 19 and luhn("".join(c for c in found if c in "0123456789"))
    return 9 <= digits <= 15


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base, parts, owner = [], [], []
    for i, text in enumerate(texts):
        base.append(base_spans(text))
        for a, b in stretches(text):
            parts.append(text[a:b])
            owner.append((i, a))
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, a), spans in zip(owner, model_spans(tagger, parts), strict=True):
        found[i] += [(k, a + s, a + e) for k, s, e in spans]
    out = []
    for text, own, more in zip(texts, base, found, strict=True):
        taken = sorted((s, e) for _, s, e in own)
        starts = np.array([s for s, _ in taken])
        ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else np.zeros(0)
        extra = []
        for k, s, e in more:
            before = int(np.searchsorted(starts, e, "left")) if taken else 0
            cut_off = text[s - 1 : s].isalnum() or text[e : e + 1].isalnum()
            if (before and ends[before - 1] > s) or cut_off or not _plausible(k, text[s:e]):
                continue
            extra.append((k, s, e))
        out.append((own, sorted(set(own) | set(extra), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(shared, names: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            column = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                got += all_spans(shared.value, [t or "" for t in column.slice(at, 256).to_pylist()])
            counts = [pa.array([sum(k == kind for k, _, _ in own) for own, _ in got], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(_written(own).encode()).hexdigest() for own, _ in got], pa.string())
            spans = pa.array([_written(every) for _, every in got], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *counts, digest, spans], [*names, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return find


def _sample(rows: DataFrame, sample_rows: int, sample_chars: int, seed: int) -> list[str]:
    """About sample_rows different texts with a digit or @, those of least hash; only counts and these reach the driver."""
    some = rows.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars)).withColumn("h", F.xxhash64("text", F.lit(seed)))
    n = some.select("h").distinct().count()
    below = F.lit(-(1 << 63) + min((1 << 64) - 1, (1 << 64) * sample_rows // max(1, n)))
    return [r["text"] for r in sorted(some.where(F.col("h") <= below).dropDuplicates(["h"]).select("h", "text").collect())]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400, sample_chars: int = 20_000, seed: int = 3) -> DataFrame:
    """One row for each row of docs: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    The tagger learns from the base spans of about sample_rows texts, of those of up to sample_chars characters; all texts are searched.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(_sample(rows, sample_rows, sample_chars, seed), seed))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(_find(shared, [id_col]), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
