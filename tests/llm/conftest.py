import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["ba", "ko", "ti", "ru", "me", "sho", "lan", "ver"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """A few hundred texts with copies, near copies, odd white space, other scripts, empty and null ones."""
    rng = random.Random(9)
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    out = list(some)
    for t in some[:40]:
        own = t.split()
        own[rng.randrange(len(own))] = "changed"
        out.append(" ".join(own))
    out += some[:10] + ["", None, "   ", "\n\n", "a  b\t c\r\nd ", "日本語 のテキスト 🙂", "Don't I'LL we've 12 345x", "İstanbul ΟΔΟΣ ﬁ", "x"]
    out += ["\n".join(some[k : k + 4]) for k in range(0, 40, 3)]
    out.append(" ".join(rng.choice(words) for _ in range(8000)))
    return out


@pytest.fixture
def docs(spark, texts):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(spark):
    """Extra columns named like those of results and helpers, nulls everywhere, a repeated row."""
    schema = "text string, doc_id bigint, fp bigint, n_tokens string, score string, removed string, k int, h string, a int, line string, toxic int"
    rows = [("one two three four five\nsix", 1, None, "x", None, "r", 1, "h", 1, "l", 1), (None, 2, 5, None, None, None, None, None, None, None, None)]
    rows += [rows[0], ("alone", None, 1, "y", "z", "r", 2, "h", 2, "l", 0), ("", 3, 1, "y", "z", "r", 2, "h", 2, "l", 0)]
    return spark.createDataFrame(rows, schema)
