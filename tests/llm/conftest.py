import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, ids string, fingerprint string, rate string"
WORDS = "the of and to in river stone market winter garden letter window people carry follow under bright small old".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        k = rnd.randint(4, 9)
        sentence = [rnd.choice(WORDS) + (str(rnd.randint(0, 99)) if rnd.random() < 0.3 else "") for _ in range(k)]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, copies and near copies."""
    long = prose(1, 9000)
    base = prose(2, 120)
    texts = [
        None, "", " \n\t ", "one", "two words", base, base, base.replace("river", "stone", 1), base + " Some more words here.",
        long, long[2000:9000] + prose(3, 40), "é" * 400, "x" + "é" * 300, "For " * 700, "For " * 500, prose(4, 60) + "\n" + base[:400],
        "日本語 текст ñandú <|endoftext|> it's 50% #done", prose(5, 80), prose(6, 80) + "\x00\x0b\x0c end.",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows.append((None, base[:300], "fr", "s1", 5, None, None, None, None))
    rows.append((5, prose(7, 70), "de", "s2", 5, None, None, None, None))  # a key that is there twice
    rows.append(rows[9])  # a repeated row
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
