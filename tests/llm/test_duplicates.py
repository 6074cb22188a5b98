"""Line dedup, SimHash near-dedup, components, nearest neighbours, decontamination against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from foliospark.llm import ann, components, decontam, linededup, simhash
from pyspark.sql import functions as F


def brute_lines(rows):
    """Removed lines by the rule itself: an earlier line with word sets of similarity 4 / 5 or more."""
    lines = sorted({(d, n, frozenset(x.lower().split())) for d, t in rows if d is not None for n, x in enumerate((t or "").split("\n")) if x.split()}, key=lambda r: r[:2])
    out = set()
    for k, (d, n, own) in enumerate(lines):
        if any(5 * len(own & o) >= 4 * len(own | o) for _, _, o in lines[:k]):
            out.add((d, n))
    return out


def test_line_dedup_equals_brute_force(spark, words):
    rng = random.Random(8)
    base = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(60)]

    def line():
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        return "  ".join(own) if rng.random() < 0.2 else "\t".join(own).title()

    rows = [(k, "\n".join(rng.choice([line(), line(), "", " "]) for _ in range(rng.randint(1, 8)))) for k in range(90)]
    rows += [(200, None), (None, rows[0][1]), (201, ""), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], n) for r in linededup.line_decisions(docs).collect() for n in r["removed"]}
    assert got == brute_lines(rows)
    assert len(got) > 50
    left = linededup.drop_lines(docs).collect()
    assert len(left) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in left if r["doc_id"] is not None}
    for d, t in rows:
        if d is not None:
            assert texts[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in got) if any(g[0] == d for g in got) else t)
    assert any(r["doc_id"] is None and r["text"] == rows[0][1] for r in left)


def test_line_dedup_odd_inputs(clashing, empty):
    assert linededup.line_decisions(empty).count() == 0
    out = linededup.drop_lines(clashing)
    assert out.columns == clashing.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in clashing.collect())


def test_line_dedup_plan_has_no_python(docs):
    plan = linededup.line_decisions(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_makes_keys_from_numbers_alone(spark):
    """Keys are the rarity's byte above 56 bits of the hash, in order, and no string is made for a word to find its byte."""
    rarity = bytes(33 + k * 7 % 94 for k in range(linededup.BUCKETS))
    texts = ["one two  two three", "", " ", "caf\u00e9 \u65e5\u672c x x", " ".join(f"w{k}" for k in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "words string").select("words", linededup._keys(F.col("words"), rarity).alias("k"))
    assert not rows.schema["k"].dataType.containsNull
    assert not re.search("substr|ascii", rows._jdf.queryExecution().optimizedPlan().toString())
    for r in rows.collect():
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(r["words"].split(" ")) - {""}]
        assert r["k"] == sorted(rarity[h % linededup.BUCKETS] << 56 | h & (1 << 56) - 1 for h in hashes)


def test_line_dedup_meets_by_size(spark):
    """Lines far apart in size don't meet, however rare the word they share; like lines of any sizes do, also across classes."""
    step = {(4, 5): 1, (1, 1): 1, (1, 2): 1, (2, 5): 2, (1, 5): 3}
    assert {x: linededup._step(*x) for x in step} == step
    texts = [(k, 0, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate((*range(1, 41), 63, 64, 65, 79, 80, 81, 130, 200))]
    lines = spark.createDataFrame(texts, "doc_id bigint, line bigint, words string")
    for num, den in ((4, 5), (2, 5)):
        rows = linededup._prefix_rows(lines, b"!" * linededup.BUCKETS, num, den).collect()
        at = {}
        for r in rows:
            at.setdefault(r["k"], set()).add((r["doc_id"], r["size_at"] >> 32))
        met = {(a, b) for own in at.values() for a, _ in own for b, _ in own}
        size = {k: len(t.split()) for k, _, t in texts}
        for a, b in itertools.combinations(size, 2):
            if size[a] * den >= size[b] * num:
                assert (a, b) in met
        digits = 2 if (num, den) == (2, 5) else 1
        assert all(4**digits * min(n for _, n in own) > max(n for _, n in own) for own in at.values())
        assert len(rows) == len({(r["doc_id"], r["k"]) for r in rows})


def test_line_dedup_across_sizes_equals_brute_force(spark):
    """Lines whose sizes lie around powers of two, copies with words left out or put in."""
    rng = random.Random(4)
    pool, rows = [f"v{k}" for k in range(400)], []
    for n in (3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 72, 127, 128, 129, 150):
        base = rng.sample(pool, n)
        for _ in range(7):
            less = rng.sample(base, n - rng.randint(0, n // 4))
            rows.append(" ".join(less + rng.sample(sorted(set(pool) - set(base)), rng.randint(0, n // 5))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {(r["doc_id"], n) for r in linededup.line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for n in r["removed"]}
    assert got == brute_lines(rows)
    assert len(got) > 30


def test_line_dedup_white_space(spark):
    """Each kind of white space parts words or leaves a line without one; texts that hold none of it are lowered alike."""
    rows = [(1, "A b C d e"), (2, "a\tB c D E\n\t\r\x0b\x0c \nx"), (3, "a\rb\x0bc\x0cd E\n \n\tX\x0c"), (4, "\u0130a \u039f\u03a3\n\u0130A \u039f\u03a3"), (5, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in linededup.line_decisions(docs).collect()}
    assert got == {1: (1, []), 2: (2, [0]), 3: (2, [0, 2]), 4: (2, [1]), 5: (1, [0])}
    pairs = spark.createDataFrame([("a  b a c", "c a a d "), ("", " "), ("x", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(linededup._common(F.col("a"), F.col("b"))).collect()] == [2, 0, 1]


def plain_fingerprint(text):
    raw = (text or "").encode()
    own = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    grams = [b" ".join(own[k : k + 4]) for k in range(len(own) - 3)] if len(own) > 4 else [b" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, radius=4):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_simhash_equals_brute_force(docs, texts):
    fps = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    roots = plain_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == roots
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(roots.values())


@pytest.mark.parametrize("n, spread", [(300, 6), (2000, 3)])
def test_pigeonhole_loses_no_link(spark, n, spread):
    """Clusters of fingerprints around a few centres, also very large ones."""
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    while len(fps) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        fps.add(x)
    own = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp bigint")
    plan = simhash.Plan.learn(own, len(own))
    assert sum(t + 1 for t in plan.thresholds) == simhash.RADIUS + 1
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    links = simhash.links(df, plan)
    got = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    want = plain_components({int(s): int(u) for s, u in zip(own.view(np.int64), own)})
    assert {k: got.get(k, k) for k in want} == want
    assert links.count() < 40 * n
    again = simhash.links(df, plan, heavy=20)  # large buckets taken apart
    got = {r["node"]: r["root"] for r in components.components(again, "a", "b").collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_components_of_any_shape(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    edges += [(5, 5), (None, 3), (61, 100)]
    df = spark.createDataFrame(edges, "x bigint, y bigint")
    got = {r["node"]: r["root"] for r in components.components(df, "x", "y").collect()}
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in list(root) if find(v) != v}


def test_simhash_odd_inputs(spark, clashing, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == 5
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} == {2}
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) + 0.2
    x[100] = x[200] = x[50]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    stored = {r["vec_id"]: r["embedding"] for r in df.collect()}
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in ann.search(df, lambda v: v % 50 == 0).collect()}
    want = ann.exact(stored, [i for i in stored if i % 50 == 0])
    assert len(got) == len(want)
    pairs = {(q, v) for q, _, v in want}
    assert len(pairs & {(q, v) for q, _, v in got}) >= 0.9 * len(pairs)
    assert (50, 1, 100) in got and (50, 2, 200) in got and (100, 1, 50) in got  # copies tie: the smaller id first
    for (q, _, v), s in list(got.items())[:50]:
        a, b = np.array(stored[q]), np.array(stored[v])
        assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_every_code_within_the_pigeonhole_radius_is_found():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << ann.SUBSTRING, (3000, 10)).astype(np.int32)
    base = codes[0].copy()
    for k in range(1, 2000):  # rows at all distances from the first
        codes[k] = base
        for bit in rng.choice(10 * ann.SUBSTRING, k % 90, replace=False):
            codes[k, bit // ann.SUBSTRING] ^= 1 << (bit % ann.SUBSTRING)
    index, sure = ann.MultiIndex(codes), 10 * (ann.REACH + 1) - 1
    for q in codes[:5]:
        bits = np.bitwise_count(codes ^ q)
        far, nearest = bits.sum(axis=1), bits.min(axis=1)
        assert index.probed(q).tolist() == np.flatnonzero(nearest <= ann.REACH).tolist()
        assert index.within(q, sure).tolist() == np.flatnonzero(far <= sure).tolist()
    assert len(index.search(codes[0], 1, 3000)) == 3000


def test_neighbours_in_the_table(spark):
    """Recall of the query over all its queries, and the share of rows that come out of the probes."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    stored = {r["vec_id"]: r["embedding"] for r in df.collect() if r["embedding"] is not None}
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, lambda v: v % 50 == 0).collect()}
    want = {(q, v) for q, _, v in ann.exact(stored, [i for i in stored if i % 50 == 0])}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    x = np.array(list(stored.values()), np.float64)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    codes = ann.Codes.learn(unit, 5)
    index = ann.MultiIndex(codes.encode(unit))
    probed = np.mean([len(index.probed(c)) for c in codes.encode(unit[::50])]) / len(unit)
    assert probed < 0.2


def test_neighbours_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (50, [1e-200, 1e-200]), (1, [1e200, -1e200]), (2, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in ann.search(df, lambda v: v % 50 == 0).collect()}
    assert {(q, v): s for (q, _, v), s in got.items()} == pytest.approx({(0, 2): 1, (0, 50): 1, (0, 1): 0, (50, 0): 1, (50, 2): 1, (50, 1): 0})
    assert (0, 3, 1) in got and (50, 3, 1) in got


def test_neighbours_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, lambda v: v % 50 == 0).collect())
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.search(df.where("vec_id is null"), lambda v: v % 50 == 0).count() == 0
    assert ann.search(df.limit(0), lambda v: v % 50 == 0).count() == 0


def plain_hits(text, items, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        n = min(size, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(item)
    return words, hit, found


def test_contamination_equals_brute_force(spark, texts, words):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 13, 20, 40])))) for k in range(12)] + [(50, ""), (51, None), (3, "ÉL único, Ñandú 日本")]
    own = []
    for k, t in enumerate(texts):
        if k % 3 == 0 and t:
            item = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(item))
            t = t[: len(t) // 2] + " -- " + ", ".join(item[at:]).upper() + "! " + rng.choice(items)[1].__str__() + " " + t[len(t) // 2 :]
        own.append(t)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    for k, t in enumerate(own):
        w, hit, found = plain_hits(t, items)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        if hit:  # the spans hold the hit words and nothing else
            inside = [x for s in r["spans"] for x in plain_hits(t[s["start"] : s["end"]], [])[0]]
            assert inside == [w[i] for i in sorted(hit)]
    left = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert left == {k for k, r in got.items() if not r["contaminated"]}
    assert len(list(decontam.benchmark_groups(bench, 400))) > 3
    again = {r["doc_id"]: r for r in decontam.contamination(docs, bench, max_bytes=400).collect()}  # several automata, one after another
    assert again == got


def test_contamination_odd_inputs(spark, clashing, empty):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "alone")], "item_id bigint, text string")
    assert decontam.contamination(empty, bench).count() == 0
    assert all(not r["contaminated"] for r in decontam.contamination(clashing, bench.limit(0)).collect())
    left = decontam.drop_contaminated(clashing, bench)
    assert left.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3"]
