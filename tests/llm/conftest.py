import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, block long, words int"


def made(seed=3, n=60):
    """Rows with copies, near copies, shared passages and lines, hot words, nulls, empty and long texts, and clashing column names."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in"] * 6 + ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, lines = say(70), [say(8) for _ in range(5)]
    texts = [None, "", " \t\n", "one", "one two", "a a a a a a a a a a a a"]
    for i in range(n):
        t = say(r.randint(20, 120))
        kind = i % 8
        if kind == 1:
            t = texts[r.randrange(6, len(texts))] if len(texts) > 6 else t
        elif kind == 2 and len(texts) > 8:
            w = (texts[r.randrange(6, len(texts))] or "x").split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 3:
            t = f"{t} {passage} {say(10)}"
        elif kind == 4:
            t = "\n".join([say(5), *lines, "", say(6)])
        elif kind == 5:
            t = t.upper() + "!! <b> $5 & 3%"
        texts.append(t)
    texts += [texts[10]] * 12 + [say(6000)]
    return [(i, t, ["en", "de", None, "xx"][i % 4], ["b", "a", None, "c"][min(i % 5, 3)], None if t is None else len(t), "x", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
