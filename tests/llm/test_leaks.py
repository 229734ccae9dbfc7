import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapidary.llm import leaks
from lapidary.llm.words import shingles, words


def brute(items, text, m):
    w = words(text)
    runs = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    out = set()
    for item, t in items:
        x = words(t)
        if any(tuple(x[i : i + m]) in runs for i in range(len(x) - m + 1)):
            out.add(item)
    return out


def test_words():
    assert words("Rock'n 7-up_x 汉字AB12 é") == ["rock", "n", "7", "up", "x", "汉", "字", "ab12", "é"]
    assert words(None) == words("") == words(" \t…") == []
    assert len(shingles("a b")) == 0 and len(shingles("a b c a b c")) == 3 and len(shingles(None)) == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), max_size=6), st.text("ab ", max_size=120))
def test_search_against_brute_force(texts, text):
    items = list(enumerate(texts))
    assert leaks.WuManber(items, 4).find(text) == brute(items, text, 4)


def test_default_length():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 60)))) for i in range(40)]
    table = leaks.WuManber(items)
    for _ in range(100):
        piece = items[rng.randrange(40)][1].split()
        a = rng.randrange(len(piece))
        text = " ".join([*rng.choices(vocab, k=20), *piece[a : a + rng.randrange(8, 20)], *rng.choices(vocab, k=20)])
        assert table.find(text) == brute(items, text, 12)


def test_frames(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    evals = spark.createDataFrame([(1, passage, None), (1, passage, None), (2, "short one", passage + " tail"), (3, None, ""), (None, passage, None)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "x, " + passage.upper().replace(" ", " - ")), (2, " ".join(f"word{i}" for i in range(11))), (3, None), (4, ""), (5, "a " * 200_000 + passage)], "doc_id long, text string")
    finals = spark.createDataFrame([("f", None, passage, 1), ("f", None, passage, 1), ("g", "q", None, 2)], "idx string, question string, answer string, item_id int")
    got = {tuple(r) for r in leaks.leaks(docs, finals, evals).collect()}
    assert got == {("documents", "1", 1), ("documents", "1", 2), ("documents", "5", 1), ("documents", "5", 2), ("final_records", "f", 1), ("final_records", "f", 2)}
    assert leaks.leaks(docs.limit(0), finals.limit(0), evals).count() == 0
    assert leaks.leaks(docs, finals, evals.limit(0)).count() == 0


def test_blocks(spark):
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(10)]
    evals = spark.createDataFrame([(k, p, None) for k, p in enumerate(passages)] + [(10, "x " * 500, None)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([("d", str(k), p) for k, p in enumerate(passages)], "tab string, rec_key string, text string")
    got = {(int(r.rec_key), r.item_id) for r in leaks.leaked_items(docs, evals, 200).collect()}
    assert got == {(k, k) for k in range(10)}
    rows, blocks = leaks._blocks(evals, 200)
    sizes = {r.block: (r.chars, r.items) for r in rows.groupBy("block").agg(F.sum(F.length("question")).alias("chars"), F.count("*").alias("items")).collect()}
    assert blocks > 2 and all(chars <= 200 or items == 1 for chars, items in sizes.values())


def test_memory_of_the_tables():
    """Under 60 bytes a character would be held for 1.6 million characters in 100 MB; offsets need far less."""
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=200))) for i in range(800)]
    chars = sum(len(t) for _, t in items)
    tracemalloc.start()
    table = leaks.WuManber(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held <= 30 * 2**20 + 12 * chars
    # At the stated bound that is less than a quarter of a gigabyte.
    assert 30 * 2**20 + 12 * leaks.MAX_BROADCAST_CHARS < 2**28
    assert table.find(items[7][1]) == {7}


def test_one_passage_of_many_items():
    passage = " ".join(f"w{i}" for i in range(15))
    table = leaks.WuManber([(i, passage + f" own{i}") for i in range(3000)])
    assert table.find("x " + passage) == set(range(3000)) and len(table.end) < 3000 * 4 + 20
    assert leaks.WuManber([]).find(passage) == set() and leaks.WuManber([(1, passage)]).find("") == set()
