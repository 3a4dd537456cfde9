import random

import pytest

ODD = [
    (None, "alpha beta gamma delta epsilon", "en", "s1"), (1, None, "en", None), (2, "", "en", "s1"), (3, " \n\t ", "de", "s2"), (4, "Wörter ÄÖ ß 漢字 🙂 end", "de", "s2"),
    (5, "one", "en", "s1"), (6, "one two three", "en", "s1"), (6, "one two three", "en", "s1"), (7, "ONE two Three", "en", "s3"), (8, "word " * 3000, "en", "s1"),
]


@pytest.fixture(scope="session")
def rows():
    """Small corpus: base texts, exact and near copies, shared passages, and odd rows."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage = text(70)
    out = list(ODD)
    for i in range(10, 60):
        t = text(draw.randint(30, 260))
        out.append((i, t, "en", f"s{i % 4}"))
        if i % 3 == 0:
            w = t.split()
            for j in range(draw.randint(1, 3)):
                w[draw.randrange(len(w))] = "changed"
                out.append((i * 100 + j, " ".join(w), "en", f"s{i % 5}"))
        if i % 7 == 0:
            out.append((i * 100 + 50, t, "fr", "s9"))
        if i % 5 == 0:
            out.append((i * 100 + 70, f"{text(20)} {passage} {text(10)}", "en", "s0"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
