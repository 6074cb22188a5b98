"""Toxicity, language identification and secrets against held-out rows and plain formulas."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import common, langid, secrets, toxicity

FIXTURE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: common.table(spark, FIXTURE, t) for t in ("documents", "labels")}


def test_toxicity_on_held_out_rows(tables):
    scored = toxicity.score(tables["documents"], toxicity.train(tables["documents"], tables["labels"]))
    rows = scored.join(tables["labels"], "doc_id").where("held_out").collect()
    no = [r for r in rows if r["toxic"] == 0]
    yes = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in no) <= 0.05 * len(no)
    assert sum(r["predicted"] for r in yes) >= 0.5 * len(yes)  # few dozen rows to learn from here
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.CUT) for r in rows)
    assert scored.count() == tables["documents"].count()


def test_toxicity_recall_with_labels_enough(spark):
    """Held-out documents of the 0.1 tables. About half of those labelled toxic hold no word that sets toxic documents apart (their
    labels are noise); the others are found, and ordinary documents are left alone."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    marks = labels.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "truth").where("truth is not null")
    known = docs.join(marks, "doc_id").select("doc_id", "text", "truth", common.held_out().alias("held_out"))
    words = {r["doc_id"]: set((r["text"] or "").lower().split()) for r in known.collect()}
    rows = toxicity.score(known.select("doc_id", "text"), toxicity.train(docs, labels)).join(marks, "doc_id").collect()
    seen = {t: [words[r["doc_id"]] for r in rows if not r["held_out"] and r["truth"] == t] for t in (0, 1)}
    count = collections.Counter(w for own in seen[1] for w in own)
    telling = {w for w, n in count.items() if n >= 0.05 * len(seen[1])} - set().union(*seen[0])
    yes = [r["predicted"] for r in rows if r["held_out"] and r["truth"] == 1 and words[r["doc_id"]] & telling]
    no = [r["predicted"] for r in rows if r["held_out"] and r["truth"] == 0]
    assert len(yes) > 50 and np.mean(yes) >= 0.9 and np.mean(no) <= 0.02


def test_toxicity_learns_marks():
    rng = random.Random(3)
    plain = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["snorgish", "plaxter"]

    def text(toxic):
        own = [rng.choice(plain) for _ in range(80)]
        for _ in range(4 * toxic):
            own[rng.randrange(80)] = rng.choice(bad)
        return " ".join(own)

    model = toxicity.fit([text(1) for _ in range(60)], [text(0) for _ in range(200)])
    own = toxicity.Compressor(model)
    assert b"snorgish" in model.toxic and b"plaxter" in model.toxic
    assert sum(own.score(own.evidence(text(1))) >= toxicity.CUT for _ in range(50)) >= 48
    assert sum(own.score(own.evidence(text(0))) >= toxicity.CUT for _ in range(50)) <= 1
    assert own.score(own.evidence("")) < toxicity.CUT
    assert toxicity.Compressor(toxicity.fit([], [])).evidence("any text") == 0


def test_toxicity_odd_inputs(spark, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = toxicity.score(clashing, toxicity.train(clashing, labels)).collect()
    assert len(rows) == 5 and all(r["score"] is not None for r in rows)
    kept = toxicity.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_language_lengths_by_hand():
    model = langid.PPM({"x": ["abab"], "y": ["bb"]}, order=2)
    # after 'a' in x: b twice, nothing else: 2 / (2 + 1)
    code = np.array([ord("a") << 8 | ord("b")])
    assert model.lengths(code, 1)[0, 0] == pytest.approx(-math.log2(2 / 3))
    # in y 'a' is no context, so only the empty one counts: b twice: 2 / 3
    assert model.lengths(code, 1)[0, 1] == pytest.approx(-math.log2(2 / 3))
    # an unseen byte escapes from 'a' (1 / 3) and from the empty context (2 / 6) and costs 8 bits
    assert model.lengths(np.array([ord("a") << 8 | ord("z")]), 1)[0, 0] == pytest.approx(-math.log2(1 / 3) - math.log2(2 / 6) + 8)


@pytest.mark.parametrize("order", [2, 3])
def test_language_tables_equal_the_trees(texts, order):
    own = [t or "" for t in texts[:60]]
    model = langid.PPM({"p": own[:20], "q": own[20:40], "r": []}, order)
    raw, at = common.byte_view(pa.array(own))
    got = langid.Scorer(model).score(raw, at)
    for i, t in enumerate(own):
        b = t.encode()
        want = sum((model.lengths(np.array([int.from_bytes(b[max(0, k - order) : k + 1], "big")]), min(k, order))[0] for k in range(len(b))), np.zeros(3))
        assert got[i] == pytest.approx(want)


def test_language_on_held_out_rows(tables):
    rows = langid.languages(tables["documents"]).join(tables["documents"].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_inputs(spark, empty):
    rows = spark.createDataFrame(
        [(0, "uno dos tres", "es"), (4, "one two three", "en"), (7, None, None), (None, "12 !!", "es"), (9, "", "xx"), (0, "uno dos tres", "es")],
        "doc_id bigint, text string, lang string",
    )
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.languages(rows).collect()}
    assert {(7, "und"), (None, "und"), (9, "und")} <= got
    assert langid.languages(empty).count() == 0


def test_base_patterns():
    text = 'password="abcdefgh" x TOKEN :  ab.cd=ef token=short api_key=a1b2c3d4e5 AKIAABCDEFGHIJKL AKIASHORT ' + "0" * 31 + "g" + "f" * 32
    kinds = [(k, text[a:b]) for a, b, k in secrets.base_spans(text)]
    assert kinds == [
        (0, 'password="abcdefgh'), (0, "TOKEN :  ab.cd=ef"), (0, "api_key=a1b2c3d4e5"), (1, "AKIAABCDEFGHIJKL"), (2, "f" * 32),
    ]
    assert secrets.base_spans("password: token: abcdefgh") == []  # a failing match is not looked into again
    assert secrets.base_spans("toKen=abcdefgh") == []  # only A-Z have a case here


def test_nothing_is_passed_over(texts):
    """The quick look finds every text with a base finding or a candidate."""
    rng = random.Random(4)
    own = [t or "" for t in texts]
    for k in range(0, len(own), 3):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        put = rng.choice([f" secret={key[:9]}", f" AKIA{key[:12].upper()}", " " + "abcdef" * 6, f"token:'{key}'", " AKIAABCDEFGHIJKL"])
        own[k] = own[k][: len(own[k]) // 2] + put + own[k][len(own[k]) // 2 :]
    look = secrets.worth_a_look(*common.byte_view(pa.array(own)))
    for t, l in zip(own, look):
        assert l or not (secrets.base_spans(t) or secrets.candidates(t))


def test_network_on_new_findings():
    net = secrets.train(["some words of a text here"] * 5, 1500)
    made = secrets.labelled_findings(["other words in this text"], 400, seed=99)
    own = [secrets.encode(t, a, b) for t, a, b, _ in made]
    found = net.scores(np.array([o[0] for o in own]), np.array([o[1] for o in own])) >= net.threshold
    truth = np.array([m[3] for m in made]) == 1
    assert found[truth].mean() >= 0.95
    assert found[~truth].mean() <= 0.1


def test_secret_rows(spark, clashing, empty):
    net = secrets.train(["plain words"], 400)
    text = "é password=abcdefgh1 and " + "0123456789abcdef" * 2
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secrets.scan(rows, net).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 1)
    assert got[1]["spans"].startswith("assign:2:20,hex:25:57")
    assert got[2]["base_sha256"] == got[3]["base_sha256"] and got[2]["spans"] == ""
    assert secrets.scan(clashing, net).count() == 5
    assert secrets.scan(empty, net).count() == 0
