import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from attestra.llm import bpe, queries

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "a", "aaaaaaaaaaaaaaaaaaaa", "ab" * 5_000, "é漢字 ½²　x\x1cy\x85z", "<|endoftext|>", "It's 12.5% of\n\n  all", "It's 12.5% of\n\n  all"]


def test_merges_as_the_library_does():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for alphabet in ("abc ", "aaab\n\t 'sT.19_é", "é漢½²　\x1c\x85 x٣Ⅷ", "".join(map(chr, range(1, 255)))):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert bpe.np.frombuffer(encoder(text), "i4").tolist() == LIBRARY.encode_ordinary(text), text


def test_long_pre_token():
    rng = random.Random(5)
    text = "".join(rng.choice("abcde") for _ in range(30_000))
    assert bpe.RankQueue(RANKS).merge(text.encode()) == LIBRARY.encode_ordinary(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for i in range(200):
        text = f"word{i} other{i % 7}"
        assert bpe.np.frombuffer(encoder(text), "i4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(encoder) <= 10 and len(encoder.elder) <= 10


def test_round_trip_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, FILE, public_tokenizers.PATTERN), FILE).collect()
    for row in out:
        text = TEXTS[row.doc_id] or ""
        assert row.ids == LIBRARY.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.encode(df.limit(0), FILE, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    assert F is not None
