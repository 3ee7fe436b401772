import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, a long, b long, node long, label long, rep long, blob string, path string, content string, bucket int, rank int, cell long, word string, grp long, mix_id long, block long, toxic string"


def rows(texts, langs=None, sources=None):
    out = []
    for i, (d, t) in enumerate(texts):
        out.append((d, t, (langs or ["en"])[i % len(langs or [1])], (sources or ["s1", "s2", None])[i % len(sources or [1, 2, 3])], len(t or ""), *[7] * 7, "x", "y", "z", 1, 2, 3, "w", 4, 5, 6, "t"))
    return out


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    base = random.Random(1)
    names = ["".join(base.choice("abcdefghijklmnop") for _ in range(base.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(n))


def odd_texts():
    """Nulls, empty and blank texts, one word, copies, near copies, shared passages, a very long word and a long text."""
    base = [prose(i, 60) for i in range(8)]
    near = [b.replace(" ", "  ", 1) + f" tail{i}" for i, b in enumerate(base[:4])]
    passage = prose(99, 30)
    shared = [prose(200 + i, 40) + "\n" + passage + "\n" + prose(300 + i, 40) for i in range(5)]
    drift = base[5].split()
    chain = [" ".join(drift[: 60 - 3 * i] + [f"z{i}{j}" for j in range(i)]) for i in range(6)]
    texts = [None, "", "   \n\t ", "one", "Two Words", "été ÉTÉ 日本語 😀 x", "x" * 3000, *base, *base[:3], base[0].upper(), *near, *shared, *chain, prose(5, 6000), "a b c d e", "A B C D E", "ab " * 200]
    return [(2 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(odd_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_id(spark):
    return spark.createDataFrame(rows([(None, "no id here at all in this row"), (1, "with an id"), (1, "with an id")]), SCHEMA)
