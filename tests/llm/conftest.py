from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, row long, fp long, payload binary, digest string, anchor string"
PAGES = "page_id long, url string, html string, host string, digest string, row long"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" + rng.choice(["", ",", "", "."]) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, blanks, repeats, copies, near copies and a very long one."""
    rng = random.Random(5)
    base = [" ".join(words(rng, n)) for n in (3, 40, 200, 900, 1, 2, 5, 6000)]
    near = base[3].split()
    near[450] = "changed"
    texts = [None, "", " \n\t ", *base, base[1], base[1], base[2].upper(), base[2] + "\n", " ".join(near), "12345 67 !!", "Ünïcödé ßtraße 東京 " * 5, "password = 'hunter22' token: abc AKIA" + "A1" * 10 + " " + "0a" * 13 + " secret: token: abcdef API_KEY=abcdefg", "Kſ token　= x"]
    out = [(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 7, 8, 9, b"x", "d", "a") for i, t in enumerate(texts)]
    return [*out, (None, "a null id here", "en", None, 1, None, None, None, None, None, None), out[4]]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
