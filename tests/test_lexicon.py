"""The lexicon of q61_wordbreak holds all words of the part names."""

import pytest
from foliospark import queries


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """700 words, each in one name only."""
    d = str(tmp_path_factory.mktemp("parts"))
    word = lambda k: "".join("bcdfghklmn"[int(c)] + "a" for c in f"{k:03d}")
    spark.createDataFrame([(k, f"{word(2 * k)} {word(2 * k + 1)}") for k in range(350)], "p_partkey bigint, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def test_no_word_is_left_out(spark, parts):
    names = {r["p_partkey"]: r["p_name"].upper() for r in spark.read.parquet(f"{parts}/part.parquet").collect()}
    assert {r["p_partkey"]: r["parts"] for r in queries.QUERIES["q61_wordbreak"](spark, parts).collect()} == names


def test_too_many_words_are_refused(spark, parts, monkeypatch):
    monkeypatch.setattr(queries, "MAX_LEXICON", 699)
    with pytest.raises(ValueError):
        queries.QUERIES["q61_wordbreak"](spark, parts)
