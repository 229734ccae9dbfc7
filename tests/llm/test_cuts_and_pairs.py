import random
import time

import pyarrow.parquet as pq
import pytest

from lapidary.llm import cuts, pairs, refusals

COLUMNS = "tab string, rec_key string, text string"
WHOLE = [
    "[[1 2,3 4]]", "So the result is [[1 2,\n3 4]].", "word", "WORD", "842", "1 2 3, 4 5 6", "goblet saddle timber", "goblet, saddle, timber", "That leaves 4 for the cage.", "ladder",
    "剩下的归甲。", "```json\n{\"a\": 1}\n```", '{"a": "b [[ c"}', "<solving>\nx y\n</solving>\n[[1]]", None, "", "n/a", "[[none]]", "...", "A(1,2), B(3,4)", "He said: “It is done.”",
    "<planning>\n- [ ] That leaves two.\n</planning>\n{\"q\": \"x\"}", "酒馆", "(522-3)*8+675", "Is it the last one?", "แถวที่7ต้องมีผลรวมเท่ากับ572", "n" + " " * 90 + "/a",
]
CUT = [
    "[[1 2,3 4", "[[1 2,3 4]", "[[1 2,3 4]...", "[[1 2, 3 <cut>", "[[a b [truncated]", "```json\n{\"a\": 1}", '{"a": "b', '{"a": [1, 2', "<solving>\nx y.", "<planning>\nx\n</planning>\n{\"question\": \"abc", "[[I can't be opened by a key, said",
]
PROSE_CUT = [
    "That leaves 4 for the", "That leaves 4 for th…", "It follows that the", "It follows that the...", "剩下的归甲，因为", "Sorry to the reader, but \n", "Since 821 exceeds", "I can't be", "Row 4 cannot hold another", "That leaves 4. Since 8",
    "That leaves 4 for the [some mark]", "It follows that the �", "Row 4 cannot hold another --",
]
SENTENCES = ["That leaves {} for the cage.", "It follows that the {} stood there.", "剩下的归{}，因为酒馆在傍晚关门。", "Sorry to the reader, but {} was never there.", "Since {} exceeds 8, the domino is odd.", "I can't be opened by a key, said the {}.", "Row {} cannot hold another yoke.", "The lantern of reader {} stands beside the harbour.", "It belongs to the keeper."]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [("t", f"g{i}", " ".join(s.format(rng.randrange(1000)) for s in rng.sample(SENTENCES, 5))) for i in range(n)]


def found(spark, rows, *using):
    return {r.rec_key for r in cuts.cut_values(spark.createDataFrame(rows, COLUMNS), *using).collect()}


def test_structures():
    assert [t for t in CUT if cuts.judge(t)[0] != cuts.CUT] == []
    assert [t for t in WHOLE if cuts.judge(t)[0] == cuts.CUT] == []
    # However many structures are closed before the one that isn't.
    assert cuts.judge("[[1]] " * 150_000 + "[[2")[0] == cuts.CUT and cuts.judge("[[1]] " * 150_000)[0] == cuts.WHOLE


def test_very_long_texts():
    began = time.perf_counter()
    for text in ("-" * 300_000, "a " + "-" * 300_000, "a." * 150_000, "x y " * 100_000 + "…" * 100_000, "([{" * 60_000 + "a", "{" * 100_000):
        cuts.judge(text)
    assert time.perf_counter() - began < 20


def test_prose_against_lists(spark):
    rows = corpus(80) + [("t", f"w{i}", t) for i, t in enumerate(WHOLE)] + [("t", f"c{i}", t) for i, t in enumerate(CUT + PROSE_CUT)]
    assert found(spark, rows) == {f"c{i}" for i in range(len(CUT + PROSE_CUT))}


def test_mark_after_the_break(spark):
    rows = corpus(150) + [("t", "trie", "It belongs to the keeper. The lantern of reader 4 stands beside the harb."), ("t", "gram", "That leaves 4 for the cage. It belongs to the."), ("t", "open", "[[x"), ("t", "open", "[[x"), ("t", "null", None)]
    rows += [("t", "o2", "Row 4 cannot hold another")]
    all_ = found(spark, rows)
    assert all_ == {"trie", "gram", "open", "o2"}
    # Each kind of evidence decides cases of its own.
    assert all_ - found(spark, rows, cuts.ALL - {cuts.TRIE}) == {"trie"}
    assert all_ - found(spark, rows, cuts.ALL - {cuts.NGRAMS}) == {"gram"}
    assert cuts.cut_values(spark.createDataFrame([], COLUMNS)).count() == 0


def test_length_evidence(spark):
    # Thirty values of source a are cut at 120 characters. A word that seldom stands within sentences and never at an end
    # is too little evidence by itself; together with the length of its source it is enough.
    filler = " It belongs to the keeper. Row 5 cannot hold another yoke. It belongs to the keeper."
    seldom = ["gleams", "glitters", "shimmers"]
    rows = [(*r, "a") for r in corpus(200)] + [("t", f"r{i}{w}", f"That leaves {i} for the cage. The lantern {w} beside the harbour.", "a") for i in range(1) for w in seldom]
    rows += [("t", f"p{i}", (t + filler)[:120], "a") for i, (_, _, t) in enumerate(corpus(30, 2))]
    lead = "That leaves 4 for the cage. It belongs to the keeper. Row 4 cannot hold another yoke. "
    limit, other, longer = (lead + f"The lantern {w}".rjust(120 - len(lead)) for w in seldom)
    rows += [("t", "limit", limit + ".", "a"), ("t", "other", other + ".", "b"), ("t", "longer", "So: " + longer + ".", "a")]
    df = spark.createDataFrame(rows, COLUMNS + ", source string")
    with_, without = ({r.rec_key for r in cuts.cut_values(df, using).collect()} for using in (cuts.ALL, cuts.ALL - {cuts.LENGTH}))
    assert with_ - without == {"limit"} and not without - with_
    piled = {(r.source, r.length): r.piled for r in cuts.pile_ups(df).collect()}
    assert max(piled, key=piled.get) == ("a", 120)


def test_broken_words_in_number(spark):
    # One cut value copied many times, in several looks, and a fragment that many values end with, with and without a mark;
    # a word that only ends sentences stays one, whatever it begins.
    good = [f"The lantern of reader {i} stands beside the harbour. Its column crosses no borders, and the tower is the border." for i in range(200)]
    rows = [("t", f"g{i}", t) for i, t in enumerate(good)]
    copies = [("t", f"c{i}", ("the lantern  stands beside the harb." if i % 2 else "The lantern stands beside the harb.")) for i in range(100)]
    many = [("t", f"m{i}", f"The reader {i} of the lantern stands beside the colu" + "." * (i % 3 > 0)) for i in range(9)]
    assert found(spark, rows + copies + many) == {r[1] for r in copies + many}
    stats = {r.key: (r.texts, r.text_ends) for r in cuts.corpus_statistics(spark.createDataFrame(rows + copies * 2, COLUMNS)).collect()}
    assert stats["harb"] == (1, 1) and stats["border"] == (200, 200)
    # An ending of one whole text that many records share counts for each of them.
    asked = [("t", f"a{i}", f"The reader {i} can take the lantern on to the column.") for i in range(200)]
    declined = [("t", f"d{i}", "The lantern of the reader is not something to take on.") for i in range(20)]
    assert found(spark, asked + declined * 2) == set()


def test_rates(spark):
    p = spark.createDataFrame([("1", "[[a", '{"generator": "g"}'), ("1", "[[a", '{"generator": "g"}'), ("2", "[[a]]", "broken"), ("3", None, None), ("4", "[[b]]", '{"generator": "g"}')], "id string, answer string, metadata string")
    c = spark.createDataFrame([("1", "[[a", "m"), ("2", None, None)], "trace_id string, response_raw string, model string")
    rows = {(r.tab, r.source): (r.n_values, r.n_cut, r.share) for r in cuts.cut_rates(p, c).collect()}
    assert rows == {("puzzles", "g"): (2, 1, 0.5), ("puzzles", "unknown"): (2, 0, 0.0), ("call_traces", "m"): (1, 1, 1.0), ("call_traces", "unknown"): (1, 0, 0.0)}


REFUSALS = [
    "I must decline to solve it.", "I'm sorry, but I can't help with this.", "[[As a language assistant I won't continue, ask something else.]]", "我必须拒绝上述任务，恕不提供解答。", "抱歉，我无法回答这道题。",
    "It is not possible for me to share a solution.", "I’d rather not answer this.", '{"question": null, "answer": "I am unable to write it."}', "No answer will be given here: grids are off limits for me.", "我们换个话题吧，这道题我就不答了。",
]
DECOYS = ["Sorry to the early reader, but Tomin was never there.", "I can't be opened by a key, said the jade quilt.", "抱歉让人久等，甲其实没去过渡口。", "Row 4 cannot hold another quilt.", "第7行不能再放木桶。", "[[1 2]]", "", "[[I(3,8)]]"]


@pytest.fixture(scope="module")
def documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    return sorted(t for t in set(texts) if t and len(t) < 5000)


def test_refusals(documents):
    model = refusals.Refusals.fitted(documents[:300], REFUSALS[:2] + DECOYS)
    assert sum(map(model.refuses, REFUSALS)) >= 9
    assert [t for t in DECOYS if model.refuses(t)] == []
    assert sum(map(model.refuses, documents[300:])) <= 2
    assert all(model.refuses(text.split("\n")[0]) for text in refusals.EXAMPLES.values())
    assert not refusals.Refusals.fitted([], []).refuses("")


def test_refusals_held_out_by_phrase(documents):
    """Every fourth example of each language is left out of the fit and asked about. The examples have few words in common."""
    right = total = 0
    for k in range(4):
        kept = {n: "\n".join(s for i, s in enumerate(t.split("\n")) if i % 4 != k) for n, t in refusals.EXAMPLES.items()}
        model = refusals.Refusals.fitted(documents[:150], [], kept)
        out = [s for t in refusals.EXAMPLES.values() for i, s in enumerate(t.split("\n")) if i % 4 == k]
        right, total = right + sum(map(model.refuses, out)), total + len(out)
    assert right >= 0.25 * total


EN = "The narrow messenger reaches the harbour after dusk and the keeper of the lantern waits beside the old wooden gate with a heavy basket. "
DE = "Der schmale Bote erreicht den Hafen nach der Dämmerung und der Hüter der Laterne wartet neben dem alten hölzernen Tor mit einem schweren Korb. "
FR = "Le messager étroit arrive au port après le crépuscule et le gardien de la lanterne attend près de la vieille porte en bois avec un panier. "
ZH = "信使在黄昏之后到达港口，灯笼的看守人带着沉重的篮子在古老的木门旁边等候。"


def test_languages():
    m = pairs.Languages.fitted([("en", EN * 3), ("de", DE * 3), ("fr", FR * 3), ("zh", ZH * 3)])
    assert pairs.other_language(m, EN, DE) and pairs.other_language(m, EN, "[[" + ZH + "]]") and pairs.other_language(m, ZH, EN)
    assert not pairs.other_language(m, EN, EN) and not pairs.other_language(m, ZH, "[[1 2,3 4]]") and not pairs.other_language(m, ZH, "goblet saddle")
    assert not pairs.other_language(m, ZH, '{"verdict": "PASS", "answers_match": true}')
    assert not pairs.other_language(pairs.Languages.fitted([]), EN, DE)
    p = m.posterior(EN)
    assert abs(sum(2.718281828 ** p) - 1) < 1e-6 and p.argmax() == m.names.index("en")


def test_copies():
    assert pairs.copies_question(EN, EN.upper()) and not pairs.copies_question(EN, "The narrow messenger reaches the harbour") and not pairs.copies_question(EN, DE)


def test_defects(spark):
    docs = spark.createDataFrame([(i, k, t and t * 3) for i, (k, t) in enumerate([("EN", EN), ("de", DE), ("fr-FR", FR), ("zh", ZH), ("und", "x"), (None, EN), ("en", None)])], "doc_id long, lang string, text string")
    rows = [
        ("a", EN, None), ("b", EN, "[[none]]"), ("c", EN, "[[1 2"), ("d", EN, REFUSALS[0]), ("e", EN, EN), ("f", EN, DE), ("g", EN, "[[1 2]]"), ("h", None, "[[1 2]]"), ("i", None, REFUSALS[0]), ("a", EN, None), ("j", "", DE),
    ]
    p = spark.createDataFrame(rows, "id string, question string, answer string")
    c = spark.createDataFrame([("t", ZH, EN), ("u", ZH, None)], "trace_id string, prompt_user string, response_raw string")
    got = [(r.tab, r.rec_key, r.defect) for r in pairs.defects(p, c, docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        *[("puzzles", k, d) for k, d in zip("abcdef", ("empty", "empty", "truncated", "refusal", "copy", "language"))], ("puzzles", "i", "refusal"), ("call_traces", "t", "language"), ("call_traces", "u", "empty"),
    }
    assert pairs.defects(p.limit(0), c.limit(0), docs.limit(0)).count() == 0
