"""Refusals of a task, told by a fitted classifier of sentences.

A logistic model over words and word pairs (characters and their pairs where a script has no blanks) is fitted on example
refusals in nine languages against sentences of the corpus's documents, which refuse nothing. It is then refitted with
those sentences of a sample of the answers that it takes for refusals with high confidence, and answers that it takes for
none, so that it learns how this corpus declines. Both samples are bounded. A value refuses if one of its sentences does.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Example refusals by language, from which the classifier is trained.
EXAMPLES = {
    "en": """I'm sorry, but I can't help with that request.
I cannot assist with this task.
I won't answer this question.
I am unable to provide a solution to that.
I must decline to give an answer.
I will not produce this, please ask something else.
As an AI language model I can't continue with this request.
My guidelines do not allow me to do this, so no answer is given.
This is outside my scope and I will leave it unanswered.
That request lies beyond my remit.
I would rather not write this; please ask a person instead.
I would prefer to skip this request.
It is not possible for me to solve this kind of puzzle.
Unfortunately this is not something I can take on.
I was told not to respond to that kind of request.
No solution will be provided here, such requests are off limits for me.
Let us talk about something else instead.
The assistant has no permission to continue and must stop at this point.
I have to stop here, since I am not allowed to go on with this task.
I do not respond to questions of this sort, please contact the author.
I refuse to work on this and will leave the task undone.
I'm not comfortable creating such a grid, so I have to pass on this one.""",
    "de": """Es tut mir leid, aber dabei kann ich nicht helfen.
Ich kann diese Aufgabe leider nicht lösen und gebe keine Antwort.
Ich muss es ablehnen, darauf zu antworten.
Meine Richtlinien erlauben es mir nicht, das zu beantworten.
Leider darf ich diese Anfrage nicht bearbeiten.
Das liegt außerhalb meiner Möglichkeiten, bitte fragen Sie jemand anderen.
Ich möchte diese Frage lieber nicht beantworten.
Als Sprachassistent werde ich das nicht schreiben.
Reden wir lieber über etwas anderes.""",
    "fr": """Je suis désolé, mais je ne peux pas vous aider.
Je ne peux pas répondre à cette demande.
Je dois refuser de donner une solution.
Mes consignes ne me permettent pas de répondre à cette question.
Malheureusement, je ne suis pas en mesure de traiter cette demande.
Cela dépasse mes capacités, veuillez demander à quelqu'un d'autre.
Je préfère ne pas répondre à cette question.
En tant qu'assistant, je ne vais pas écrire cela.
Parlons plutôt d'autre chose.""",
    "es": """Lo siento, pero no puedo ayudar con eso.
No puedo responder a esta solicitud.
Debo negarme a dar una respuesta.
Mis normas no me permiten responder a esta pregunta.
Lamentablemente no me es posible resolver esta tarea.
Esto queda fuera de mi alcance, pregunte a otra persona.
Prefiero no contestar a esta pregunta.
Como asistente no voy a escribir eso.
Hablemos mejor de otra cosa.""",
    "ru": """Извините, но я не могу помочь с этим.
Я не могу ответить на этот запрос.
Я вынужден отказаться давать ответ.
Правила не позволяют мне отвечать на этот вопрос.
К сожалению, я не в состоянии выполнить это задание.
Это выходит за рамки моих возможностей, обратитесь к другому.
Я предпочёл бы не отвечать на этот вопрос.
Как помощник я не буду это писать.
Давайте лучше поговорим о другом.""",
    "ja": """申し訳ありませんが、お手伝いできません。
すみませんが、その質問にはお答えできません。
その依頼はお断りします。
規定により、この問題に答えることはできません。
残念ながら、この課題は対応できません。
それは私の能力の範囲を超えています。
回答は控えさせていただきます。
アシスタントとして、それを書くことはできません。
別の話題にしましょう。""",
    "zh": """抱歉，我无法回答这个问题。
对不起，我不能提供帮助。
我必须拒绝这个请求，恕不回答。
根据使用准则，我不便给出答案。
很遗憾，这超出了我的能力范围。
作为语言助手，我不能处理这个请求。
这道题恕我不能奉陪。
这个忙我帮不上，请另找他人。
我们换个话题吧，这个我就不答了。
本助手未获授权，只能到此为止。
恕难从命，我不会写这样的内容。
我不方便继续，我们谈点别的吧。""",
    "th": """ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้
ขอโทษด้วย ฉันไม่สามารถตอบคำถามนี้ได้
ฉันต้องขอปฏิเสธคำขอนี้
กฎไม่อนุญาตให้ฉันตอบ
น่าเสียดายที่ฉันทำสิ่งนี้ให้ไม่ได้
เรื่องนี้เกินขอบเขตของฉัน
ฉันขอไม่ตอบคำถามนี้
เรามาคุยเรื่องอื่นกันดีกว่า""",
    "hi": """क्षमा करें, मैं इसमें मदद नहीं कर सकता।
माफ़ कीजिए, मैं इस सवाल का जवाब नहीं दे सकता।
मुझे यह अनुरोध अस्वीकार करना होगा।
मेरे नियम मुझे इसका उत्तर देने की अनुमति नहीं देते।
दुर्भाग्य से मैं यह काम नहीं कर पाऊँगा।
यह मेरे दायरे से बाहर है।
मैं इस प्रश्न का उत्तर नहीं देना चाहूँगा।
आइए किसी और बात पर चर्चा करें।""",
}

_SENTENCE = re.compile(r"[^.!?。！？।\n]+[.!?。！？।]*")
_STRUCTURE = re.compile(r'```[a-z]*|</?[a-z_]+>|\[\[|\]\]|[{}]|"[a-z_]+":|"')
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TIGHT = re.compile("[฀-๿぀-ヿ㐀-鿿]")
BITS = 16
_MASK = (1 << BITS) - 1
ROUNDS, RATE, RIDGE, SURE = 80, 0.1, 2e-4, 0.9
#: Share of the weight that refusals have in the fit; a sentence refuses beyond this probability.
SHARE, LEAST = 0.5, 0.35
#: A sentence of fewer words and pairs tells nothing.
FEWEST = 6


def sentences(value: str) -> list[str]:
    """The sentences of a value, without the names and brackets of its structures."""
    return [s.strip() for s in _SENTENCE.findall(_STRUCTURE.sub("\n", value)) if s.strip()]


_UNITS: dict[tuple[str, bool], list[str]] = {}
_IDS: dict = {}
_KEPT = 300_000


def _units_of(word: str, first: bool) -> list[str]:
    key = (word, first)
    units = _UNITS.get(key)
    if units is None:
        if len(_UNITS) > _KEPT:
            _UNITS.clear()
        if _TIGHT.search(word):
            units = list(word)
        else:
            units = ["N" if word[0].isupper() and not first and len(word) > 1 and "'" not in word else word.lower()]
        _UNITS[key] = units
    return units


def _id(gram) -> int:
    i = _IDS.get(gram)
    if i is None:
        if len(_IDS) > _KEPT:
            _IDS.clear()
        i = _IDS[gram] = xxhash.xxh32_intdigest(gram if isinstance(gram, str) else " ".join(gram)) & _MASK
    return i


def features(sentence: str) -> list[int]:
    """Hashes of the words and runs of two and three words of a sentence. Capitalised words after the first are names and don't count."""
    units: list[str] = []
    for m in _WORD.finditer(sentence.replace("’", "'")):
        units += _units_of(m.group(), not units)
    if 3 * len(units) - 1 < FEWEST:
        return []
    return sorted({*map(_id, units), *map(_id, zip(["^", *units], units)), *map(_id, zip(units, units[1:], units[2:]))})


def _fit(positive: list[list[int]], negative: list[list[int]]) -> np.ndarray:
    """Weights of the hashes, the last one the constant."""
    rows = [*positive, *negative]
    y = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
    weight = np.where(y > 0, SHARE / max(1, len(positive)), (1 - SHARE) / max(1, len(negative)))
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # Long sentences weigh no more than short ones.
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    w, m, v = np.zeros(_MASK + 2), np.zeros(_MASK + 2), np.zeros(_MASK + 2)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(at, w[flat], len(rows)) * scale + w[-1]
        d = weight * (y - 1 / (1 + np.exp(-z)))
        g = np.r_[np.bincount(flat, (d * scale)[at], _MASK + 1), d.sum()] - RIDGE * w * np.r_[np.full(_MASK + 1, 1 / 100), 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w.astype(np.float32)


class Refusals:
    """The fitted classifier. ``documents`` refuse nothing, ``answers`` may; both are samples."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._seen: dict[str, bool] = {}

    @classmethod
    def fitted(cls, documents: list[str], answers: list[str], examples: dict[str, str] | None = None) -> Refusals:
        positive = [features(s) for text in (examples or EXAMPLES).values() for s in text.split("\n")]
        negative = [features(s) for s in sorted({s for d in documents for s in sentences(d)})]
        own = [features(s) for s in sorted({s for a in answers for s in sentences(a)})]
        own = [f for f in own if len(f) >= FEWEST]
        model = cls(_fit(positive, negative))
        for _ in range(2):
            p = np.array([model.probability(f) for f in own])
            more = [f for f, x in zip(own, p) if x >= SURE]
            less = [f for f, x in zip(own, p) if x <= 1 - SURE]
            model = cls(_fit(positive + more, negative + less))
        return model

    def probability(self, of: list[int]) -> float:
        if len(of) < FEWEST:
            return 0.0
        z = float(self.weights[of].sum()) / len(of) ** 0.5 + float(self.weights[-1])
        return float(1 / (1 + np.exp(-z)))

    def refuses(self, value: str) -> bool:
        for s in sentences(value):
            known = self._seen.get(s)
            if known is None:
                if len(self._seen) > 100_000:
                    self._seen.clear()
                known = self._seen[s] = self.probability(features(s)) >= LEAST
            if known:
                return True
        return False
