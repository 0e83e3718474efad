import pytest

WORDS = [f"w{i}{c}" for i in range(60) for c in "abcde"]


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
        if i % 27 == 26:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n").strip()


@pytest.fixture(scope="session")
def rows():
    """Documents of all awkward kinds: (doc_id, text, lang, source)."""
    base = prose(1, 120)
    near = base.replace("w1", "q1", 1)
    line = "This line is in many of the documents."
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, "   \n\t", "en", "b"), (7, "few words", "en", "b"), (8, "few words", None, "b"),
        (9, line + "\n" + prose(2, 60), "en", "a"), (10, line.upper() + " \n" + prose(3, 60), "en", "a"), (11, prose(4, 20000), "en", "a"), (12, prose(4, 20000), "en", "a"),
        (13, "été « déjà » 漢字 " * 30, "fr", "c"), (14, "été « déjà » 漢字 " * 30 + "x", "fr", "c"), (15, "The The The " * 60, "en", "a"), (16, "a" * 300, "en", "a"), (17, "a" * 400, "en", "a"),
        (None, base, "en", "a"), (None, None, None, None), (18, base, "en", "a"), (18, base, "en", "a"),
    ]
    return out + [(100 + i, prose(50 + i, 80) + "\n" + line, "en", "a") for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those that operators add."""
    extra = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_bytes string, copy string, key string, spans string, lines string, shard string, comp string, c string"
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 10) for r in rows], extra).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
