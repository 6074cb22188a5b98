"""Each class that is learned from keeps its share of the bytes, whatever the others hold."""

import random

import pytest
from foliospark.llm import common, langid, toxicity

DOCS = "doc_id bigint, text string, lang string"


def unheld(spark, n):
    """n ids that are not held out."""
    return [r["doc_id"] for r in spark.range(10 * n).selectExpr("id as doc_id").where(~common.held_out()).limit(n).collect()]


def test_large_texts_of_one_language_leave_the_others_theirs(spark):
    ids = unheld(spark, 12)
    rows = [(i, "der hund und die katze " * 40, "de") for i in ids[:4]] + [(i, "the dog and the cat " * 40, "en") for i in ids[4:8]]
    rows += [(i, "el perro y el gato " * (4000 if i == ids[8] else 4), "es") for i in ids[8:]]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, max_bytes=1000)
    raw = dict(zip(model.languages, model.bits[0].T))
    assert model.languages == ["de", "en", "es"] and all((own < 8).any() for own in raw.values())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got == {i: x for i, _, x in rows}


def test_texts_within_the_bound_and_one_at_least(spark):
    docs = spark.createDataFrame([(1, "a" * 50), (2, "b" * 500), (3, "c" * 40), (4, "d" * 300), (5, "é" * 80)], "doc_id bigint, text string")
    got = common.texts_by_id(docs, [[2, 1, 3, 9], [2, 4], [5, 3], []], 120)
    assert [list(x) for x in got] == [[1, 3, 9], [4], [3], []]


def test_one_huge_text_does_not_leave_toxicity_without_a_model(spark):
    ids = unheld(spark, 40)
    docs = spark.createDataFrame([(i, f"w{k}x " + ("snorgish plaxter " if k % 2 else "plain words ") * (5000 if k < 2 else 5)) for k, i in enumerate(ids)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, max_bytes=10_000)
    assert b"snorgish" in model.toxic and model.toxic != model.ordinary


@pytest.mark.parametrize("bad", [["voxa", "wuzi"], ["vox", "wuz"], ["xv", "qw"], ["x", "w"]])
def test_toxic_words_of_few_letters(bad):
    rng = random.Random(3)
    plain = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def text(toxic):
        own = [rng.choice(plain) for _ in range(80)]
        for at in rng.sample(range(80), 4 * toxic):
            own[at] = rng.choice(bad)
        return " ".join(own)

    own = toxicity.Compressor(toxicity.fit([text(1) for _ in range(60)], [text(0) for _ in range(200)]))
    assert sum(own.score(own.evidence(text(1))) >= toxicity.CUT for _ in range(50)) >= 45
    assert sum(own.score(own.evidence(text(0))) >= toxicity.CUT for _ in range(50)) <= 2


def test_all_ordinary_texts_are_learned_from(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda n, samples, **_: seen.extend(samples) or toxicity.zstandard.ZstdCompressionDict(b"x" * 9000))
    toxicity._common([f"word{k} other" for k in range(1000)], 4096)
    assert len(seen) == 1000
