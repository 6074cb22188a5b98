"""Byte-level BPE, token counts, token files, perfect hashes."""

import base64
import bisect
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from foliospark.llm import bpe, common, mph, tokencounts, tokenfile
from foliospark.llm.queries import RANKS, WORDS
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    own = mph.MinimalPerfectHash.build(keys)
    assert sorted(own.slots(keys).tolist()) == list(range(5000))
    others = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    assert (own.find(others) == -1).mean() > 0.999
    for n in (0, 1, 2, 3):
        assert sorted(mph.MinimalPerfectHash.build(keys[:n]).slots(keys[:n]).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(keys[[0, 0]])


def test_bpe_equals_the_library_and_decodes(spark, docs, texts, reference):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANKS, P.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids
        assert got[k]["n_tokens"] == len(ids)
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_both_tiers(reference):
    own = bpe.ByteBPE(open(RANKS, "rb").read(), P.PATTERN)
    assert own.whole([b" the", b"qzqzqzq"]) == [reference.encode_ordinary(" the")[0], -1]
    for piece in (b"qzqzqzq", b"aaaaaaaaaaaaaaaaaaaaaaa", "ñandúes".encode(), bytes(range(256))):
        assert own.decode(np.array(own.merge(piece))) == piece
    assert own.merge(b"aaaaaaaaaaaaaaaaaaaaaaa") == reference.encode_ordinary("aaaaaaaaaaaaaaaaaaaaaaa")


def test_a_small_memo_gives_the_same(texts):
    raw = open(RANKS, "rb").read()
    big, small = (bpe.TextEncoder(bpe.ByteBPE(raw, P.PATTERN), limit) for limit in (10**6, 3))
    own = [t or "" for t in texts]
    want, _ = big.encode_batch(own)
    got = np.concatenate([small.encode_batch(own[k : k + 5])[0] for k in range(0, len(own), 5)])
    assert got.tolist() == want.tolist()


def test_histogram_sums(spark, docs, texts, empty, reference):
    lengths = sorted(len(reference.encode_ordinary(t or "")) for t in texts)
    rows = tokencounts.suffix_sums(tokencounts.histogram(bpe.count_tokens(docs, RANKS, P.PATTERN)), block=7).collect()
    assert sorted(r["limit_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["limit_tokens"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_at_least"] == sum(n >= limit for n in lengths)
        assert r["truncated_tokens"] == sum(min(n, limit) for n in lengths)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    sums = tokencounts.token_counts(docs, RANKS, P.PATTERN)
    for limit in (0, 5, 10**6):
        assert tokencounts.truncated_total(sums, limit).first()["truncated_tokens"] == sum(min(n, limit) for n in lengths)
    assert tokencounts.token_counts(empty, RANKS, P.PATTERN).count() == 0
    assert tokencounts.truncated_total(tokencounts.token_counts(empty, RANKS, P.PATTERN), 5).first().asDict() == {"docs": 0, "tokens": 0, "truncated_tokens": 0}


def test_token_file(spark, docs, texts, empty, monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for size in (2048, 8):  # one shard, and many shards of several blocks
        monkeypatch.setattr(tokenfile, "BLOCK_DOCS", size)
        blocks = tokenfile.write_token_file(docs, common.fresh_path(spark, "t"), WORDS)
        rows = sorted(tokenfile.read_documents(blocks).collect(), key=lambda r: r["doc_id"])
        assert len(rows) == len(want)
        start = 0
        for r, ids in zip(rows, want):
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        for key in (0, 57, len(texts) - 1):
            assert [x.tolist() for x in tokenfile.lookup(blocks, key)] == [want[key]]
        assert tokenfile.lookup(blocks, 10**9) == []
    assert tokenfile.token_file_rows(spark, empty, WORDS).count() == 0


def test_signs_at_the_ends_of_words_make_no_new_pieces(words):
    """A word is encoded once, whatever signs follow it; ids are the library's with every sign and letter, special tokens too."""
    tokenizer = Tokenizer.from_file(WORDS)
    encoder = tokenfile.WordEncoder(open(WORDS, "rb").read())
    seen, encode = [], encoder.memo.encode
    encoder.memo.encode = lambda units: seen.extend(units) or encode(units)
    signs = [s for c in map(chr, range(33, 127)) if not c.isalnum() for s in (c, c * 3, f",{c}", f"{c}.", f"'{c}")]
    ends = ["the", "caf\u00e9", "\u00c9T\u00c9", "e\u0301", "stra\u00dfe", "don't", "x1", "\u0434\u0430", "<|endoftext|>", "<|endoftext", "a\u00d7"]
    texts = [f"{w}{s} {after}" for w in ends for s in signs for after in ("s b", "\u0338x", s, "|>", "ll")] + [None, ""]
    ids, at = encoder.encode_column(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    seen.clear()
    encoder.encode_column(pa.array([f"{w}{s} z" for w in words[:50] for s in ("", "###", "!!", ",$$$", ".", ")", '"')]))
    assert set(seen) <= {*words[:50], "z", "###", "!!", ",$$$", ".", ")", '"'}


def test_token_file_with_nulls_and_repeated_ids(spark, clashing):
    blocks = tokenfile.write_token_file(clashing, common.fresh_path(spark, "t"), WORDS)
    rows = sorted(tokenfile.read_documents(blocks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3]
    assert rows[1]["ids_crc32"] == rows[2]["ids_crc32"]
    assert len(tokenfile.lookup(blocks, 1)) == 2
    assert [r["n_tokens"] for r in rows][3:] == [1, 1]


def test_odd_inputs(spark, clashing, empty):
    rows = bpe.encode_documents(clashing, RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == sorted((i, n) for i, n in [(0, 1), (1, 6), (1, 6), (2, 0), (3, 0)]) or len(rows) == 5
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


def test_shards_by_bounds(spark):
    """The column that deals documents to shards, with bounds in many groups, equals a plain search."""
    rng = random.Random(4)
    ids = [rng.randint(-(10**12), 10**12) for _ in range(300)]
    for n in (0, 1, 63, 64, 65, 200):
        bounds = sorted(rng.sample(ids, n))
        rows = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id bigint").select("doc_id", tokenfile._shard_column(bounds).alias("s")).collect()
        assert all(r["s"] == (0 if r["doc_id"] is None else bisect.bisect_left(bounds, r["doc_id"])) for r in rows)
