"""Problem 6: values whose end is missing.

A value is read as a sequence of structures (bracket pairs ``[[``, fences, tags, JSON objects) and prose. It is cut if a
structure that it opens is never closed; that is read off the value. What follows the last structure is judged by
evidence from the whole corpus:

* Prose or not: the pairs of adjacent words of the tail are looked up among those of sentences that end with a mark
  somewhere in the corpus. Word lists, grids and lone words have few such pairs; they are whole.
* Prose without a sentence mark at its end (an ellipsis is none) breaks off within a sentence.
* Prose with a mark at its end may still be cut (a mark put after the break). Three log-likelihood ratios of a break
  against a whole text are added, and the value is cut if they outweigh the prior odds, which are those of the prose
  values that break off without a mark:
  - end-of-text n-grams: a break falls on any word, a whole text ends on words that end sentences, so the ratio is that of
    the overall rate of ends to the interpolated rate of ends after the last word, and after the word before it with the
    shape of the last one;
  - the vocabulary trie: the last word is unknown and a proper prefix of known words, so a break within a word is as
    likely as those words are frequent, and a new word that happens to be such a prefix is unlikely by its length;
  - length: where a source's distinct values pile up at one length, next to the lengths around it, and the value without
    the mark has that length. Length only adds to one of the other two, as it proves nothing alone.

The trie is a table of prefixes that is joined with the last words, so the vocabulary needn't fit in one place. It counts
texts with the same letters and digits once, so that copies of a cut value don't make its fragment a word; the n-grams
count every record but the value itself, as whole values recur as well.
Values without content (null, blank, no letter or digit, only a word for nothing) are no case. Repeated deliveries
count once. A lone word, number, word list or grid is whole; Thai prose has no sentence marks and counts as whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.session import durable

#: Words for nothing, as letters and digits in lower case.
NOTHING = {"na", "none", "null", "nil", "nan", "无", "没有", "空"}
#: Sentence marks, closing marks, and what is put after a break.
TERMINAL = ".!?。！？।｡．"
CLOSERS = "\"'”’»“」』）)]】》›"
_ALNUM = re.compile(r"[^\W_]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_OPEN = re.compile(r"```|\[\[|<([a-z][a-z_]*)>|\{")
_THAI = re.compile("[฀-๿]")
_HAN = re.compile("[぀-ヿ㐀-鿿]")
_DECODE = json.JSONDecoder(strict=False)


def no_content(text: str | None) -> bool:
    if text is None or not _ALNUM.search(text):
        return True
    return _NOT_ALNUM.sub("", text).lower() in NOTHING


def _close_json(text: str, at: int) -> int:
    """Where the object that opens at ``at`` ends, or -1."""
    try:
        return _DECODE.raw_decode(text, at)[1]
    except ValueError:
        pass
    depth, inside, i = 0, False, at
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def tail_of(text: str) -> str | None:
    """What follows the last closed structure; None if a structure is left open."""
    at = 0
    while True:
        m = _OPEN.search(text, at)
        if not m:
            return text[at:]
        what, end = m.group(), m.end()
        if what == "```":
            stop = text.find("```", end)
            stop = stop + 3 if stop >= 0 else -1
        elif what == "[[":
            stop = text.find("]]", end)
            stop = stop + 2 if stop >= 0 else -1
        elif what == "{":
            # Prose may hold a brace; an object stands at the start of a line and opens with a field or closes at once.
            before = text[at : m.start()].rstrip(" \t")
            if (before and before[-1] not in "\n:>") or not re.match(r'\s*(?:["}]|$)', text[end : end + 40]):
                at = end
                continue
            stop = _close_json(text, m.start())
        else:
            stop = text.find(f"</{m.group(1)}>", end)
            stop = stop + len(m.group(1)) + 3 if stop >= 0 else -1
        if stop < 0:
            return None
        at = stop


_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:['’][^\W_]+)*")
_ELLIPSIS = re.compile(r"(?:\.{2,}|…+)$")


def _shape(token: str) -> str:
    return ("9" if token[-1].isdigit() else "") + ("X" if token[0].isupper() else "9" if token[0].isdigit() else "x" if token[0] < " " else token)


def end_keys(tail: str) -> tuple[str, str]:
    """Keys of the last token, and of the token before it with the last one's shape."""
    last = before = ""
    for m in _TOKEN.finditer(tail, max(0, _start_of_last_two(tail))):
        before, last = last, m.group()
    return last.lower(), f"{before.lower() or '^'}|{_shape(last)}" if last else ""


def _start_of_last_two(tail: str) -> int:
    """A place before the last two tokens: behind the third blank or Han character from the end."""
    seen, i = 0, len(tail.rstrip()) - 1
    while i > 0 and seen < 4:
        seen += tail[i].isspace() and not tail[i - 1].isspace() or bool(_HAN.match(tail[i]))
        i -= 1
    return i


def pair_keys(tail: str) -> list[str]:
    """Keys of the pairs of adjacent words, of which one at least is no number, and which only blanks stand between."""
    out, at, before = [], -1, ""
    for m in _TOKEN.finditer(tail):
        t = m.group()
        if before and not tail[at : m.start()].strip() and not (before[0].isdigit() and t[0].isdigit()):
            out.append(f"{before.lower()}|{_shape(t)}")
        at, before = m.end(), t
    return out


WHOLE, CUT, ENDED, OPEN_END = 0, 1, 2, 3


def judge(text: str | None) -> tuple[int, str, str, list[str], int]:
    """(state, key of the last token, key of the last two, keys of all pairs, length without the mark at the end): whole,
    cut, or a tail that ends with a sentence mark or without one, which is whole unless it is prose."""
    if no_content(text):
        return WHOLE, "", "", [], 0
    tail = tail_of(text)
    if tail is None:
        return CUT, "", "", [], 0
    start, stop = len(text) - len(tail), len(tail)
    # Whatever was put after the text, but for sentence marks.
    while stop and not tail[stop - 1].isalnum() and tail[stop - 1] not in TERMINAL:
        stop -= 1
    if not _ALNUM.search(tail, 0, stop):
        return WHOLE, "", "", [], 0
    ended = tail[stop - 1] in TERMINAL and not _ELLIPSIS.search(tail[max(0, stop - 3) : stop])
    while not tail[stop - 1].isalnum():
        stop -= 1
    core = tail[:stop]
    if not ended and _THAI.search(tail):
        return WHOLE, "", "", [], 0
    if not ended and _HAN.search(core) and len(_TOKEN.findall(core)) < 5 and not re.search(r"[，、；：,;:\d]", core):
        return WHOLE, "", "", [], 0  # a lone word
    pairs = pair_keys(core)
    return (ENDED if ended else OPEN_END, *end_keys(core), pairs, start + len(core)) if pairs else (WHOLE, "", "", [], 0)


_PIECE = re.compile(r"([぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:['’][^\W_]+)*)([^\w぀-ヿ㐀-鿿]*)")
_BREAKS = re.compile(r"[\[\](){}<>|\n\"]")
_KEYS_AT_ONCE = 300_000


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens and of pairs, and how often a sentence mark follows: in all records, and in the first of all texts
    with the same letters and digits, where the end of a text without a mark tells nothing of its last token; and of the
    pairs within sentences of such texts that end with a mark."""
    one: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = zip(*one.values()) if one else ((),) * len(COUNTS)
        out = pa.RecordBatch.from_arrays([pa.array(list(one), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["key", *COUNTS])
        one.clear()
        return out

    def add(key: str, n: int, ended: int, told: int, prose: int) -> None:
        v = one.get(key)
        if v is None:
            v = one[key] = [0] * len(COUNTS)
        v[0] += n
        v[1] += n * ended
        v[2] += told
        v[3] += told * ended
        v[4] += prose

    for batch in batches:
        for text, records, first in zip(*[c.to_pylist() for c in batch.columns]):
            before, close, run, found = "^", False, [], _PIECE.findall(text)
            for at, (token, after) in enumerate(found, 1):
                low = token.lower()
                mark = after.lstrip()
                ended = 1 if mark and mark[0] in TERMINAL and mark[:2] != ".." else 0
                told = 1 if first and (ended or at < len(found)) else 0
                pair = f"{before}|{_shape(token)}"
                add(low, records, ended, told, 0)
                add(pair, records, ended, told, 0)
                if close:
                    run.append(pair)
                close = bool(after) and not after.strip() or not after
                if ended:
                    if first:
                        for key in run:
                            add(key, 0, 0, 0, 1)
                    run, close = [], False
                elif _BREAKS.search(after):
                    run, close = [], False
                before = "^" if ended else low
            if len(one) > _KEYS_AT_ONCE:
                yield flush()
    yield flush()


#: Occurrences and ends in all records, in texts that differ, and occurrences in ended sentences of such texts.
COUNTS = ("n", "ends", "texts", "text_ends", "prose")
#: A known word stands at least so often within sentences. A token that ends more texts is a word, unless it is this rare
#: next to a word that it begins, and as rare within sentences next to its ends.
KNOWN, ENDS, RARE = 2, 3, 0.05
#: A tail is prose if this share of its pairs is known; the weight of the shorter context in the rate of ends; letters of
#: the alphabet that a new word's next letter is as good as drawn from; lengths around one that are compared with it.
PROSE, WEIGHT, LETTERS, AROUND = 0.3, 1.0, 12.0, 8
#: The kinds of evidence.
TRIE, NGRAMS, LENGTH = "trie", "ngrams", "length"
ALL = frozenset((TRIE, NGRAMS, LENGTH))


def corpus_statistics(values: DataFrame) -> DataFrame:
    """(key, n, ends, texts, text_ends) over all values; ``values`` has tab, rec_key, text. It is read several times, so it
    is written once."""
    norm = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    rows = values.where("text is not null").select("tab", "rec_key", "text").distinct().groupBy("text").agg(F.count("*").alias("records"))
    rows = rows.withColumns({"h1": F.xxhash64(norm), "h2": F.hash(norm)})
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("text")) == 1
    counts = rows.select("text", "records", first.alias("first")).mapInArrow(_statistics, "key string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return durable(counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def _is_prose(tails: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows of ``tails`` (with pairs) that are prose. Equal lists of pairs are looked up once."""
    lists = durable(tails.select("pairs").distinct().withColumn("id", F.xxhash64("pairs")))
    each = lists.select("id", F.size("pairs").alias("many"), F.explode("pairs").alias("key"))
    known = each.join(stats.where(F.col("prose") >= KNOWN).select("key"), "key", "left_semi").groupBy("id", "many").count()
    prose = known.where(F.col("count") >= PROSE * F.col("many")).select("id")
    return tails.join(lists.join(prose, "id", "left_semi").select("pairs"), "pairs", "left_semi")


def pile_ups(values: DataFrame) -> DataFrame:
    """(source, length, piled): how many times as many distinct texts of a source have a length as have each length around it, on average."""
    by = values.where("text is not null").select("source", F.length("text").alias("length"), F.xxhash64("text").alias("h")).distinct().groupBy("source", "length").count()
    around = Window.partitionBy("source").orderBy("length").rangeBetween(-AROUND, AROUND)
    others = (F.sum("count").over(around) - F.col("count")) / F.lit(2 * AROUND)
    return by.select("source", "length", ((F.col("count") + 1) / (others + 1)).alias("piled"))


def broken_ends(ends: DataFrame, stats: DataFrame, values: DataFrame, rate: float, using: frozenset = ALL) -> DataFrame:
    """(tab, rec_key) of the rows of ``ends`` (tab, rec_key, k1, k2, source, length) that are cut before the mark at their end.

    ``rate`` is the share of cut values among those that end in prose without a mark and those that end with one."""
    totals = stats.where(~F.col("key").contains("|")).agg(F.sum("n"), F.sum("ends"), F.sum(F.col("texts") * F.length("key")), F.sum("text_ends"), F.sum(F.when((F.col("texts") == 1) & (F.col("text_ends") == 1), 1).otherwise(0))).first()
    n, e, letters, text_ends, new = (float(x or 0) for x in totals)
    overall, novel = (e + 1) / (n + 2), (new + 1) / (text_ends + 2)
    pairs = durable(ends.select("k1", "k2").distinct())
    joined = (
        pairs.join(stats.select(F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("ends").alias("e1"), F.col("texts").alias("t1"), F.col("text_ends").alias("te1")), "k1", "left")
        .join(stats.select(F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("ends").alias("e2")), "k2", "left")
        .select("k1", "k2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n1", "e1", "t1", "te1", "n2", "e2")])
    )
    # The record itself doesn't count. A number tells nothing, only what stands before it does.
    less = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    number = F.col("k1").rlike("[0-9]")
    p1 = F.when(number, F.lit(overall)).otherwise((less("e1") + WEIGHT * overall) / (less("n1") + WEIGHT))
    p2 = (less("e2") + WEIGHT * p1) / (less("n2") + WEIGHT)
    ngrams = F.log(overall / p2)
    # The trie: every proper prefix of a known word, with how often such words occur, and the most frequent of them.
    known = stats.where((F.col("texts") >= KNOWN) & ~F.col("key").contains("|") & (F.length("key") > 1) & ~F.col("key").rlike("^[0-9]"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring(F.col("key"), F.lit(1), i))
    nodes = known.select("texts", F.explode(prefixes).alias("k1")).groupBy("k1").agg(F.max("texts").alias("most"), F.sum("texts").alias("longer"))
    inside = F.col("t1") - F.col("te1")
    few = (inside < KNOWN) & (F.col("te1") < ENDS)
    rare = ((inside < KNOWN) | (inside <= RARE * F.col("te1"))) & (F.col("t1") <= RARE * F.col("most"))
    fragment = ~number & F.col("most").isNotNull() & (few | rare)
    trie = F.when(fragment, F.log((F.col("longer") / F.lit(max(letters, 1.0))) / novel) + F.length("k1") * math.log(LETTERS)).otherwise(0.0)
    scored = joined.join(nodes, "k1", "left").select("k1", "k2", (ngrams if NGRAMS in using else F.lit(0.0)).alias("ngrams"), (trie if TRIE in using else F.lit(0.0)).alias("trie"))
    scored = durable(scored.where("ngrams > 0 or trie > 0"))
    told = ends.join(scored, ["k1", "k2"])
    evidence = F.greatest("ngrams", F.lit(0.0)) + F.greatest("trie", F.lit(0.0))
    if LENGTH in using:
        told = told.join(pile_ups(values), ["source", "length"], "left")
        evidence = evidence + F.log(F.greatest(F.coalesce("piled", F.lit(1.0)), F.lit(1.0)))
    return told.where(evidence >= -math.log(min(max(rate, 1e-4), 0.5))).select("tab", "rec_key")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states, k1, k2, pairs, lengths = zip(*map(judge, batch.column(2).to_pylist())) if batch.num_rows else ((), (), (), (), ())
        columns = [pa.array(lengths, pa.int32()), pa.array(states, pa.int32()), pa.array(k1, pa.string()), pa.array(k2, pa.string()), pa.array(pairs, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], ["tab", "rec_key", "source", "length", "state", "k1", "k2", "pairs"])


JUDGED = "tab string, rec_key string, source string, length int, state int, k1 string, k2 string, pairs array<string>"


def generator() -> Column:
    return F.coalesce(F.get_json_object("metadata", "$.generator"), F.lit("unknown"))


def values_of(puzzles: DataFrame, call_traces: DataFrame) -> DataFrame:
    """(tab, rec_key, text, source): the source is the generator of the metadata, or the model, where the columns are there."""
    of_p = generator() if "metadata" in puzzles.columns else F.lit("unknown")
    of_c = F.coalesce("model", F.lit("unknown")) if "model" in call_traces.columns else F.lit("unknown")
    p = puzzles.select(F.lit("puzzles").alias("tab"), F.col("id").alias("rec_key"), F.col("answer").alias("text"), of_p.alias("source"))
    return p.union(call_traces.select(F.lit("call_traces").alias("tab"), F.col("trace_id").alias("rec_key"), F.col("response_raw").alias("text"), of_c.alias("source")))


def cut_tails(judged: DataFrame, values: DataFrame, using: frozenset = ALL) -> DataFrame:
    """(tab, rec_key) of the values that break off in prose. ``judged`` has the columns of JUDGED, of the states ENDED and OPEN_END."""
    stats = corpus_statistics(values)
    open_prose = durable(_is_prose(judged.where(F.col("state") == OPEN_END), stats).select("tab", "rec_key"))
    ended = judged.where(F.col("state") == ENDED)
    cut, whole = open_prose.count(), ended.count()
    # Only of what looks broken need it be known whether it is prose.
    broken = durable(broken_ends(ended.drop("pairs"), stats, values, cut / (cut + whole) if cut else 0.0, using))
    return open_prose.union(_is_prose(ended.join(broken, ["tab", "rec_key"], "left_semi"), stats).select("tab", "rec_key"))


def cut_values(values: DataFrame, using: frozenset = ALL) -> DataFrame:
    """(tab, rec_key) of the values whose end is missing; ``values`` has tab, rec_key, text and perhaps source. ``using``
    are the kinds of evidence for marked ends."""
    if "source" not in values.columns:
        values = values.withColumn("source", F.lit("unknown"))
    values = values.select("tab", "rec_key", "text", "source")
    judged = durable(values.mapInArrow(_judged, JUDGED).where(F.col("state") != WHOLE))
    return judged.where(F.col("state") == CUT).select("tab", "rec_key").union(cut_tails(judged, values, using)).distinct()


def cut_rates(puzzles: DataFrame, call_traces: DataFrame) -> DataFrame:
    """(tab, source, n_values, n_cut, share) per generator of the metadata (puzzles) and per model (call_traces).

    Values that are null count in n_values; a source that is missing or stands in metadata that doesn't parse is ``unknown``.
    """
    of = values_of(puzzles, call_traces).drop("text").groupBy("tab", "rec_key").agg(F.min("source").alias("source"))
    cut = cut_values(values_of(puzzles, call_traces)).withColumn("cut", F.lit(1))
    joined = of.join(cut, ["tab", "rec_key"], "left")
    return joined.groupBy("tab", "source").agg(F.count("*").alias("n_values"), F.count("cut").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
