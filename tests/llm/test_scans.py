import random
import re

import pytest

from folium.llm import decontaminate, licenses, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LICENSED = [
    (1, "Licensed under CC BY-NC 4.0. All rights reserved. cc by cc by"), (2, None), (3, ""), (4, "GNU General Public License v3 ... all Rights, reserved"), (5, "Released under the MIT License."),
    (6, "SPDX-License-Identifier: Apache-2.0"), (7, "plain text with no terms"), (8, "Éall rights reserved all rights"), (9, "cc by"), (9, "cc by"),
]


def test_license_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in LICENSED], "doc_id long, text string, labels string")
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    want = []
    for i, t in LICENSED:
        w = WORD.findall((t or "").translate(LOWER))
        at = [(j, label) for phrase, label in licenses.BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=lambda x: x[0])


def test_license_rules_suppress_what_lies_inside(spark):
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(LICENSED, "doc_id long, text string")).collect()}
    assert labels[1] == "cc-by,cc-by-nc-4.0,reserved"
    assert labels[4] == "gpl,gpl-3.0,reserved"
    assert (labels[5], labels[6], labels[7]) == ("mit", "apache-2.0", "")
    assert len(licenses.rules()) > 200
    assert licenses.scan(spark.createDataFrame(LICENSED, "doc_id long, text string").limit(0)).count() == 0


def _made(draw, parsed):
    """A random text that a parsed expression matches."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            kind, y = draw.choice(x)
            out += chr(y if str(kind) == "LITERAL" else draw.randint(*y))
        elif op == "BRANCH":
            out += _made(draw, draw.choice(x[1]))
        elif op == "SUBPATTERN":
            out += _made(draw, x[3])
        elif op == "MAX_REPEAT":
            out += "".join(_made(draw, x[2]) for _ in range(draw.randint(x[0], x[1])))
    return out


def test_license_rules_match_without_other_words(spark):
    draw, table = random.Random(5), [(r[0], re.compile(f" (?:{r[2]})(?= )"), r[3], r[5]) for r in licenses.rules()]
    made = [f"Foo {_made(draw, re._parser.parse(r[2]))} qux" for r in licenses.rules() for _ in range(4)]
    assert {r[0] for r in licenses.rules()} >= {label for label, *_ in licenses.NAMES}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    for i, t in enumerate(made):
        text = f" {' '.join(WORD.findall(t.translate(LOWER)))} "
        spans = [(label, rank, base, text[: m.start()].count(" "), text[: m.end()].count(" ")) for label, p, rank, base in table for m in p.finditer(text)]
        inside = lambda s: any(not o[2] and o[3] <= s[3] and o[4] >= s[4] and (o[1] > s[1] or (o[1] == s[1] and o[4] - o[3] > s[4] - s[3])) for o in spans)
        assert spans and got[i] == ",".join(sorted({s[0] for s in spans if s[2] or not inside(s)})), t


def test_license_names_need_no_further_word(spark):
    want = {
        "Licensed under GPL v3": "gpl-3.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "Distributed under MIT.": "mit", "released under the BSD 3-Clause": "bsd-3-clause",
        "subject to the terms of EUPL 1.2": "eupl-1.2", "available under Apache 2.0": "apache-2.0", "released under CC0": "cc0-1.0", "mit einem Wort": "", "cddl 1.1 or lgpl 2.0": "",
        "GNU Library General Public License 2.1": "gpl,lgpl-2.1",
    }
    spdx = "MPL-2.0 MPL-1.1 LGPL-2.1 LGPL-3.0 AGPL-3.0 EPL-1.0 EPL-2.0 CDDL-1.0 CPL-1.0 Artistic-1.0 Artistic-2.0 Apache-1.1 MS-PL MS-RL PostgreSQL OpenSSL GFDL-1.3 OFL-1.1 Python-2.0 ISC Zlib Unlicense WTFPL"
    want |= {f"SPDX-License-Identifier: {x}": x.lower() for x in spdx.split()} | {"SPDX-License-Identifier: BSL-1.0": "boost-1.0", "SPDX-License-Identifier: CDDL-1.1": ""}
    rows = list(enumerate(want))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want


def test_benchmark_passages_with_substitutions_are_found(spark):
    draw = random.Random(9)
    text = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    items = [(k, " ".join(text(30))) for k in range(20)] + [(20, "too short"), (21, None)]
    docs, want = [(None, None), (1, ""), (2, "w1"), (3, " ".join(text(500)))], set()
    for k in range(20):
        w = items[k][1].split()
        for j in range(0, k % 4):
            w[7 * (j + 1)] = "other"
        docs.append((100 + k, " ".join(text(40)) + ", " + " ".join(w).upper() + ". " + " ".join(text(5))))
        want.add((100 + k, k))
    docs.append((100, docs[4][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        assert r["n_equal"] == 30 - r["item_id"] % 4 and r["doc_start"] == 40
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").limit(0), bench).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0


def _accepted(same):
    """Equal words of the best stretch, as the comparison of one diagonal counts them."""
    score = equal = best = best_equal = 0
    for x in same:
        equal = (equal if score > 0 else 0) + 1 if x else equal
        score = max(score, 0) + 1 if x else score - 2
        if score > best:
            best, best_equal = score, equal
    return best_equal


def test_every_accepted_stretch_holds_a_seed():
    found, todo = set(), [(1, 1, 1, (True,))]
    while todo:  # all patterns of a positive score without a hit
        score, best, equal, same = todo.pop()
        for x in (True, False):
            now, line = score + (1 if x else -2), (*same, x)
            if now <= 0 or (x and any(len(line) > m[-1] and all(line[len(line) - 1 - m[-1] + j] for j in m) for m in decontaminate.MASKS)):
                continue
            assert not (now > best and equal + x >= 10), line
            state = (now, max(best, now), min(equal + x, 10), line[-10:])
            if state not in found:
                found.add(state)
                todo.append(state)


def test_substitutions_of_every_period_and_phase_are_found(spark):
    draw = random.Random(10)
    text = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    kept = [[i % p != phase for i in range(n)] for p in range(4, 10) for phase in range(p) for n in (30, 60)]
    kept += [[draw.random() > 0.2 for _ in range(30)] for _ in range(60)] + [[True, True, True, *[False, True, True] * 3, True]]
    items = [(k, text(len(same))) for k, same in enumerate(kept)]
    docs = [(k, " ".join(text(20) + [w if x else "other" for w, x in zip(item, kept[k])] + text(20))) for k, item in items]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k): _accepted(same) for k, same in enumerate(kept) if _accepted(same) >= 10}
    assert len(got) > 100


PERSONAL = "Mail a.b+c@x-y.example.org, ä@b.c x@y, ip 10.0.0.255 999.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112, phone +49 (30) 1234-5678 +1 2."


def plain(text):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    for kind, pattern in (("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if pii._passes(kind, m.group())]
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii.train([PERSONAL])


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice("a1@.-+ ()9%") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans(PERSONAL) == plain(PERSONAL)
    assert pii.base_spans("0" * 6000 + ".1.1.1") == plain("0" * 6000 + ".1.1.1")


def test_gradient_is_right():
    import numpy as np

    chars, tags = pii.windows_of(pii.made_up(6, 2))
    net = pii.Tagger(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, g = net.gradient(chars[:3], tags[:3])
    for name in net.w:
        flat, slope = net.w[name].reshape(-1), g[name].reshape(-1)
        i = int(np.abs(slope).argmax())
        keep, e = flat[i], 1e-4
        flat[i] = keep + e
        up = net.gradient(chars[:3], tags[:3])[0]
        flat[i] = keep - e
        down = net.gradient(chars[:3], tags[:3])[0]
        flat[i] = keep
        assert slope[i] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-3)


def test_tagger_on_unseen_spans(tagger):
    unseen = pii.made_up(300, 77)
    hit = total = said = 0
    for (_, want), got in zip(unseen, pii.model_spans(tagger, [t for t, _ in unseen])):
        hit += len(set(want) & set(got))
        total += len(want)
        said += len(got)
    assert hit / total > 0.75 and hit / said > 0.75


def test_personal_data_rows(spark, tagger):
    rows = [(1, PERSONAL), (2, None), (3, ""), (4, "none here"), (1, PERSONAL), (5, "x " * 5000 + "me@here.example.com " + "1" * 300)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base = plain(text)
        assert r["base_sha256"] == pii.hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))| ({""} if not base else set())
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_long_texts(spark):
    rows = [(1, "the mit license " * 4000), (2, "word " * 700 + "all rights reserved " * 300)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["labels"], len(got[1]["spans"])) == (12000, "mit", 4000 + 3999)  # "the mit license", "license the mit"
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (300, 700, 700 + 3 * 299)


def test_tags_of_long_stretches_join_up(tagger):
    text = " ".join(f"call +49 30 {i:03d} {7000 + i}" for i in range(400))
    got = pii.all_spans(tagger, [text])[0]
    assert len(got[0]) == 400 and set(got[0]) <= set(got[1])
    assert pii.all_spans(tagger, ["1" * 50_000]) == [([], [])]


def test_plain_notices_give_their_labels(spark):
    want = {
        "licensed under the GNU GPL version 2": "gpl-2.0", "GPL version 2": "gpl-2.0", "see the GNU GPL": "gpl", "AGPLv3": "agpl-3.0", "GNU Affero GPL v3": "agpl-3.0",
        "BSD License": "bsd", "licensed under the terms of the BSD license": "bsd", "the new BSD license": "bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "SPDX-License-Identifier: 0BSD": "0bsd", "SPDX-License-Identifier: MIT-0": "mit-0", "SPDX-License-Identifier: MIT": "mit", "Dual licensed under MIT and GPL": "gpl,mit",
        "dual licensed under the GPL and MIT": "gpl,mit", "dual-licensed under the GPLv2 or the BSD license": "bsd,gpl-2.0", "GNU LGPL v2.1": "lgpl-2.1", "GPLv3": "gpl-3.0",
        "an MPL 2.0 file": "mpl-2.0", "the gnu manual": "", "a bsd system": "", "mit students": "",
    }
    rows = list(enumerate(want))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {text: got[i] for i, text in rows} == want
