import random

import pytest

#: Columns with the names that operators use for their own.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, block int, score double, shard int, _size long, _text string, _row long, kept boolean, key string, node long"


def odd_rows():
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    texts = [None, "", " ", "\n", "one", "one", "two words", "é日 \U0001f600", long_, "same text here again " * 9, "same text here again " * 9, "token = abcdefghijklmnop", "a\n\nb\n" * 5]
    rows = [(i, t, "en", f"s{i % 3}", None, 1, 2, 0.5, 3, 4, "x", 5, True, "k", 6) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated whole
    rows += [(None, "no id", None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10), (9, "other text of id 9", "de", None, 3, *[None] * 10)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame(odd_rows(), CLASH).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with exact and near copies, shared passages, lines and junk."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(90)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, lines = [say(rng.randint(8, 40)) for _ in range(8)], [say(6) for _ in range(5)]
    texts = []
    for _ in range(160):
        parts = [rng.choice(shared) if rng.random() < 0.3 else say(rng.randint(1, 30)) for _ in range(rng.randint(0, 8))]
        parts += [rng.choice([x, x.upper(), f" \t{x} "]) for x in lines if rng.random() < 0.1]
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    texts += [rng.choice(texts) for _ in range(30)]
    for _ in range(60):
        t = rng.choice(texts).split(" ")
        for _ in range(max(1, len(t) // 40)):
            t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += ["=-" * 200, "=-" * 150, "é日" * 60, "", None]
    rng.shuffle(texts)
    return spark.createDataFrame([(i * 7 % 1009, t, "en", f"s{i * i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).cache()
