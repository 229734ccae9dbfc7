"""Problem 7: defective pairs of prompt and response, each with its one defect.

In this order: ``empty`` (no content), ``truncated`` (as in problem 6, with its end-of-text likelihood), ``refusal`` (by a
classifier fitted on examples in nine languages and the corpus itself), ``copy`` (most word shingles of the answer stand
in the question), ``language``. Languages are compared by the posteriors of a character n-gram naive Bayes model, fitted
on a bounded sample of the labelled documents. The fitted tables, of fixed size, go to the workers.

A null answer is empty. With a null or empty question only empty, truncated and refusal can be told. Repeated
deliveries count once. Ties between languages count as the same language.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm import cuts
from lapidary.llm.refusals import Refusals
from lapidary.llm.words import words
from lapidary.session import durable

#: The models are fitted on at most so many labelled documents and answers, chosen by a hash, of at most so many characters each.
SAMPLE, ANSWERS, LONGEST = 1500, 5000, 20_000
#: Of those documents so many are examples of what refuses nothing.
REFUSING_NOTHING = 500
_BITS = 14
_LETTER = re.compile(r"[^\W\d_]")
COPY_WORDS, COPY_SHARE = 8, 0.8
#: Prose has at least so many letters (Han and kana count threefold), and a language must win by so many nats.
PROSE_LETTERS, MARGIN = 24, 12.0

def copies_question(question: str, answer: str) -> bool:
    a = words(answer)
    if len(a) < COPY_WORDS:
        return False
    q = words(question)
    of_a, of_q = set(zip(a, a[1:], a[2:])), set(zip(q, q[1:], q[2:]))
    return len(of_a & of_q) >= COPY_SHARE * len(of_a)


_STRUCTURE = re.compile(r"```[a-z]*|</?[a-z_]+>|\[\[|\]\]")
_GRIDS = re.compile(r"\b[A-Z]\(\d+,\d+\)|[\d+*/=()\[\]{}<>|-]+")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_KEYWORD = re.compile(r"\b[A-Z_]{2,}\b|\b[A-Z][a-z]+\b")


def _strings(value, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            _strings(v, out)
    elif isinstance(value, list):
        for v in value:
            _strings(v, out)


def prose(text: str) -> str:
    """The running text of a value: without JSON names, tag names, numbers, grids and word lists."""
    out: list[str] = []
    plain = _STRUCTURE.sub("\n", text)
    at = plain.find("{")
    if at >= 0:
        try:
            value, end = json.JSONDecoder(strict=False).raw_decode(plain, at)
            _strings(value, out)
            plain = plain[:at] + "\n" + plain[end:]
        except ValueError:
            pass
    out.append(plain)
    kept = []
    for part in out:
        part = _STRUCTURE.sub("\n", part)
        for line in part.split("\n"):
            # Whole prose ends with a sentence mark (but for Thai) and has several words.
            bare = line.rstrip().rstrip(cuts.CLOSERS)
            if cuts._THAI.search(line) or bare[-1:] in cuts.TERMINAL and next(islice(cuts._TOKEN.finditer(line), 3, None), None):
                kept.append(_GRIDS.sub(" ", line))
    return " ".join(kept)


class Languages:
    """Character n-gram naive Bayes over hashed 1- to 3-grams: ``logs`` of the grams by language, and of the priors."""

    def __init__(self, names: list[str], logs: np.ndarray, priors: np.ndarray):
        self.names, self.logs, self.priors = names, logs, priors

    @classmethod
    def fitted(cls, samples: list[tuple[str, str]]) -> Languages:
        names = sorted({k for k, _ in samples})
        counts = np.full((max(1, len(names)), 1 << _BITS), 0.05)
        texts = np.ones(max(1, len(names)))
        for name, text in samples:
            np.add.at(counts[names.index(name)], cls.grams(text), 1)
            texts[names.index(name)] += 1
        return cls(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T.copy(), np.log(texts / texts.sum()))

    @staticmethod
    def grams(text: str) -> np.ndarray:
        # Names and numbers tell no language.
        text = _NO_LETTERS.sub(" ", _KEYWORD.sub(" ", text)).lower()
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        if len(c) < 3:
            return np.empty(0, np.int64)
        one = c * np.uint64(0x9E3779B1)
        two = (c[:-1] * np.uint64(0x85EBCA77) + c[1:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B1)
        three = (c[:-2] * np.uint64(0x27D4EB2F) + c[1:-1] * np.uint64(0x165667B1) + c[2:] * np.uint64(0x85EBCA77)) * np.uint64(0x9E3779B1)
        return (np.concatenate([one, two, three]) >> np.uint64(18) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def posterior(self, text: str) -> np.ndarray:
        """Logarithms of the posterior probabilities of the languages."""
        rows = self.logs[self.grams(text)]
        z = self.priors + (np.ones(len(rows), np.float32) @ rows).astype(np.float64)
        return z - np.logaddexp.reduce(z)


def letters(text: str) -> int:
    return sum(map(str.isalpha, text)) + (0 if text.isascii() else 2 * len(cuts._HAN.findall(text)))


def other_language(model: Languages, question: str, answer: str) -> bool:
    a = prose(answer)
    if letters(a) < PROSE_LETTERS or not model.names:
        return False
    q = prose(question) or question
    if letters(q) < PROSE_LETTERS / 2:
        return False
    of_q, of_a = model.posterior(q), model.posterior(a)
    asked, given = int(np.argmax(of_q)), int(np.argmax(of_a))
    return asked != given and of_a[given] - of_a[asked] > MARGIN and of_q[asked] - of_q[given] > MARGIN / 2


def samples(documents: DataFrame, pairs: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """At most SAMPLE labelled documents (label in two small letters, text), and ANSWERS answers, of at most LONGEST characters."""
    lang = F.lower(F.substring("lang", 1, 2))
    kept = documents.where("lang is not null and text is not null").select("doc_id", lang.alias("lang"), "text")
    kept = kept.where(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "un") & (F.length("text") <= LONGEST))
    labelled = [(r.lang, r.text) for r in kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    some = pairs.where(F.length("text") <= LONGEST).select("text").orderBy(F.xxhash64("text"), "text").limit(ANSWERS)
    return labelled, [r.text for r in some.collect()]


_MODELS: dict[int, tuple[Languages, Refusals]] = {}


def _defects(shared, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _MODELS:
            _MODELS.clear()
            *of_languages, weights = shared.value
            _MODELS[number] = Languages(*of_languages), Refusals(weights)
        languages, refusals = _MODELS[number]
        for batch in batches:
            out = []
            for q, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                state, *keys, rest = cuts.WHOLE, "", "", [], 0, None
                if cuts.no_content(a):
                    rest = "empty"
                else:
                    state, *keys = cuts.judge(a)
                    if state != cuts.CUT:
                        if refusals.refuses(a):
                            rest = "refusal"
                        elif q and copies_question(q, a):
                            rest = "copy"
                        elif q and other_language(languages, q, a):
                            rest = "language"
                out.append((keys[3], state, *keys[:3], rest))
            lengths, s, k1, k2, lists, rest = zip(*out) if out else ((),) * 6
            columns = [pa.array(lengths, pa.int32()), pa.array(s, pa.int32()), pa.array(k1, pa.string()), pa.array(k2, pa.string()), pa.array(lists, pa.list_(pa.string())), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["tab", "rec_key", "source", "length", "state", "k1", "k2", "pairs", "rest"])

    return run


def defects(puzzles: DataFrame, call_traces: DataFrame, documents: DataFrame) -> DataFrame:
    """(tab, rec_key, defect) of every defective pair."""
    spark = puzzles.sparkSession
    of_p = cuts.generator() if "metadata" in puzzles.columns else F.lit("unknown")
    of_c = F.coalesce("model", F.lit("unknown")) if "model" in call_traces.columns else F.lit("unknown")
    pairs = puzzles.select(F.lit("puzzles").alias("tab"), F.col("id").alias("rec_key"), of_p.alias("source"), "question", F.col("answer").alias("text")).union(
        call_traces.select(F.lit("call_traces").alias("tab"), F.col("trace_id").alias("rec_key"), of_c.alias("source"), F.col("prompt_user").alias("question"), F.col("response_raw").alias("text"))
    )
    labelled, answers = samples(documents, pairs)
    languages, refusals = Languages.fitted(labelled), Refusals.fitted([t for _, t in labelled[:REFUSING_NOTHING]], answers)
    shared = spark.sparkContext.broadcast((languages.names, languages.logs, languages.priors, refusals.weights))
    judged = pairs.mapInArrow(_defects(shared, shared._jbroadcast.id()), f"{cuts.JUDGED}, rest string")
    judged = durable(judged.where((F.col("state") != cuts.WHOLE) | F.col("rest").isNotNull()))
    cut = judged.where(F.col("state") == cuts.CUT).select("tab", "rec_key").union(cuts.cut_tails(judged, pairs.select("tab", "rec_key", "text", "source")))
    told = judged.select("tab", "rec_key", "rest").join(cut.distinct().withColumn("cut", F.lit(True)), ["tab", "rec_key"], "left")
    told = told.withColumn("defect", F.when(F.col("rest") == "empty", "empty").when(F.col("cut"), "truncated").otherwise(F.col("rest")))
    return told.where("defect is not null").select("tab", "rec_key", "defect").distinct()
