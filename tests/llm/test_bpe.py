import os
import random

import pytest
import tiktoken

from lapidary.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks()
    return bpe.Encoder(bpe.PerfectHash(ranks)), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_perfect_hash(both):
    table, ranks = both[0].table, both[2]
    assert sorted(table.keys) == sorted(ranks) and all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"\xff\xfe\xfd no such token") == -1 and len(table.keys) == len(ranks)


@pytest.mark.parametrize("alphabet", ["ab c'llve 019.,!\n\t", "aé汉字ก์ 🧩‍\xa0　\x85", "\x1c\x1f\x00 ab", "<|endoftext|> ", "हिन्दी การ 日本語 "])
def test_against_another_encoder(both, alphabet):
    own, other, _ = both
    rng = random.Random(7)
    for n in [0, 1, 2, 3, 10, 50, 300] * 12:
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert own.encode(text) == other.encode_ordinary(text)


def test_long_runs(both):
    own, other, _ = both
    for text in ("a" * 20_000, "汉" * 5_000, " " * 5_000, "ab" * 3_000 + "!" * 1_000):
        assert own.encode(text) == other.encode_ordinary(text)


def test_frame(spark, both):
    docs = spark.createDataFrame([(1, "Hello there", "en"), (2, None, "en"), (3, "", None), (1, "Hello there", "en")], "doc_id long, text string, ids string")
    rows = [(r.doc_id, r.ids) for r in bpe.encoded(docs).orderBy("doc_id").collect()]
    ids = both[1].encode_ordinary("Hello there")
    assert rows == [(1, ids), (1, ids), (2, []), (3, [])]
    assert bpe.encoded(docs.limit(0)).count() == 0


def test_round_trip(spark, both, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in bpe.encoded(rows).collect():
        assert both[1].decode(r.ids) == texts[r.doc_id]
