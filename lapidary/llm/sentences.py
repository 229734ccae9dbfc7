"""Problem 10: sentence boundaries, by a linear-chain conditional random field with Viterbi decoding.

Blank lines split a text into units. Within a unit the places that can carry the boundary tag are sentence marks, closing
quotes and brackets after such marks, and, next to Thai tokens, blanks; every other character is inside. What TESTDATA.md
fixes is not decided but given: marks in an open quote or bracket and an ellipsis alone carry no boundary, closing marks
belong to the sentence that they close.

Everything else is learned from the corpus, which has no labelled boundaries, but has ends that are not ambiguous: the
blank lines. Units are put together again with the blank line taken out (a blank in its place, or nothing in scripts
without blanks, or seldom nothing elsewhere; for Thai the blank line is the only mark, so this is text stripped of its
marks), so the joints are known boundaries in running text.

1. Over all documents it is counted how often a word before a mark (and a word with the one before it, and the word
   after) stands at such a joint and how often within units. Words are hashed into a table of fixed size, of two rows.
2. On a bounded sample of documents a logistic model tells joints from other places. Joints are boundaries drawn at
   random, so its odds divided by the share of joints among boundaries are the odds of a boundary; the share is taken
   from marks that always end a sentence. Places that come out clear get a tag, the others stay open.
3. On the same sample a chain with learned emissions and learned transitions (by what stands between two places) is
   fitted to those partial tags, and decoded by Viterbi everywhere.

A null or blank text has no sentences. Offsets count code points, end exclusive, without outer blanks. Repeated texts
are split alike; extra columns are ignored. A corpus without any joint leaves the model empty: then no place within a
unit is a boundary.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of quotes and brackets.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "‹": "›", "„": "“”", "“": "”", "‘": "’"}
_CLOSE = {c: o for o, cs in PAIRS.items() for c in cs if c not in "“’"}

_OPENED_BY = {c: "".join(o for o, cs in PAIRS.items() if c in cs) for cs in PAIRS.values() for c in cs}

_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_MARKS = ".!?。！？।॥｡．‼⁇…"
#: Marks that end a sentence wherever a capital or a script without case follows.
_SURE = set("!?。！？।॥｡‼⁇")
_SPECIAL = re.compile("[" + re.escape("".join(PAIRS) + "".join(_CLOSE) + '”’"') + "]|[" + re.escape(_MARKS) + r"]+(?:\s*[!?！？]+)*")
_THAI = re.compile("[฀-๿]")
_WORD = re.compile(r"[^\W_]")
_TOKENS = re.compile(r"\S+")
_NOT_IN_WORD = set(" \t\r\n([{\"“„«‘「『（—")
#: A run of more characters is no word: the last ones stand for it before a mark, the first ones after it.
LONGEST_WORD = 64
_RIGHT_WORD = re.compile(r"[^\w]{0,16}?((?:\w|(?<=\w)['’.](?=\w)){1,64}\.?)")
_OPENERS = "\"'“”„«»‘’¿¡([{-–—*>•「『《（"

#: Documents of the sample on which the model is fitted, and the longest text in it.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
#: Buckets of a row of the table of words, and words counted fewer times than this that tell nothing of their own.
BUCKETS, RARE = 1 << 18, 4
#: Places as which a word's own ratio counts before it outweighs that of all words.
SMOOTH = 25.0
#: A place gets a tag for the chain if its odds are beyond these.
SURE_INSIDE, SURE_BOUNDARY = 0.05, 0.4
#: Rounds and step of the fitting, and the precision of the prior of a weight, against one place.
ROUNDS, RATE, PRIOR = 80, 0.15, 1.0
#: One in so many joints gets no blank where a capital follows.
TIGHT = 16
#: Places of a sequence in training.
STRETCH = 24


_SEEN_MAX = 300_000


def pairs_of(unit: str, specials: list) -> list[tuple[int, int]]:
    """(open, close) of the outermost quotes and brackets, in order. Marks that find no partner within the unit count as ordinary characters."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # how many of each opening mark are on the stack
    out: list[tuple[int, int]] = []

    def close(openers: str, i: int) -> None:
        while True:
            c, opened = stack.pop()
            held[c] -= 1
            if c in openers:
                break
        while out and out[-1][0] > opened:
            out.pop()
        out.append((opened, i))

    for m in specials:
        c, i = m.group(), m.start()
        if c == '"' and held.get(c):
            close(c, i)
        elif c == "“" and held.get("„") or c == "”" or c in _CLOSE:
            openers = "".join(o for o in _OPENED_BY[c] if held.get(o))
            if openers:
                close(openers, i)
        elif c == '"' or c in PAIRS and c != "‘":
            stack.append((c, i))
            held[c] = held.get(c, 0) + 1
    return out


def _script(c: str) -> str:
    if c < "ɐ":
        return "9" if c.isdigit() else "l" if c.isalpha() else "."
    if "Ѐ" <= c < "԰":
        return "c"
    if "ऀ" <= c < "ঀ":
        return "d"
    if "฀" <= c < "຀":
        return "t"
    return "h" if "㐀" <= c <= "鿿" else "k" if "぀" <= c <= "ヿ" else "9" if c.isdigit() else "x" if c.isalpha() else "."


def _shape(token: str) -> str:
    """Kind of the token before a mark."""
    if not token:
        return "-"
    if token.isdigit():
        return "9"
    if any(c.isdigit() for c in token):
        return "x9" if token[-1].isdigit() else "9x"
    if "." in token[:-1]:
        return "a.b"
    n = len(token)
    return ("U" if token[0].isupper() else "l") + ("1" if n == 1 else "2" if n <= 3 else "4")


_NORMS: dict[str, str] = {}


def _norm(token: str) -> str:
    out = _NORMS.get(token)
    if out is None:
        if len(_NORMS) > _SEEN_MAX:
            _NORMS.clear()
        bare = token.strip("\"'“”„«»‘’()[],;:!?¿¡。，")
        if any(c.isdigit() for c in bare):
            out = re.sub(r"\d+", "0", bare.lower())
        else:
            out = "A" + bare[1:] if bare[:1].isupper() and not bare[1:].isalpha() and len(bare) <= 2 else bare.lower()
        _NORMS[token] = out
    return out


_END_OF_PREVIOUS = {".": "'", ",": "'", ":": "'"}


class Place:
    """A place that can carry a boundary: where it ends, the words around it, and its features but for the words."""

    __slots__ = ("end", "words", "plain", "gap", "sure")

    def __init__(self, end, words, plain, gap, sure):
        self.end, self.words, self.plain, self.gap, self.sure = end, words, plain, gap, sure


def places(unit: str) -> list[Place]:
    """All places of a unit in order."""
    specials = list(_SPECIAL.finditer(unit))
    outer = pairs_of(unit, specials) if specials else []
    partner = {b: a for a, b in outer}
    n, inner_until, at_pair = len(unit), -1, 0
    found: list[tuple[int, int, str, str]] = []  # end, start of the mark, mark, state of a quote
    for m in specials:
        c, i, end = m.group(), m.start(), m.end()
        while at_pair < len(outer) and outer[at_pair][0] < i:
            inner_until = outer[at_pair][1]
            at_pair += 1
        quote = ""
        if c[0] in _MARKS:
            if i < inner_until or (len(c) > 1 or c == "…") and not any(x in _SURE for x in c):
                continue
            mark = c.rstrip()[-1]
        elif i in partner:
            opened = partner[i]
            inner = unit[opened + 1 : i].rstrip()
            if not inner or inner[-1] not in _MARKS:
                continue
            before = unit[max(0, opened - 8) : opened].rstrip() or unit[:opened].rstrip()
            quote = unit[opened] + ("s" if not before or before[-1] in _MARKS or before[-1] in "”」』»\"" else "i" if before[-1] in ":：,，、" else "m") + ("…" if inner.endswith(("...", "…")) else inner[-1])
            mark = c
            while i > opened + 1 and (unit[i - 1] in _MARKS or unit[i - 1].isspace() or unit[i - 1] in "\"'”’»」』"):
                i -= 1
        else:
            continue
        # Closing marks without a partner that directly follow belong to the sentence.
        while end < n and unit[end] in "\"'”’»)]" and end not in partner and (end + 1 == n or unit[end + 1].isspace()) and unit[end] not in PAIRS:
            end += 1
        found.append((end, i, mark, quote))
    tokens = [m.span() for m in _TOKENS.finditer(unit)]
    starts = [a for a, _ in tokens]
    if _THAI.search(unit):
        taken = {f[0] for f in found}
        inside = lambda x: (q := bisect_right(opens, x) - 1) >= 0 and outer[q][1] > x
        opens = [a for a, _ in outer]
        thai = [bool(_THAI.search(unit[a:b])) for a, b in tokens]
        for k in range(1, len(tokens)):
            at = tokens[k - 1][1]
            if (thai[k - 1] or thai[k]) and at not in taken and not inside(at):
                found.append((at, at, " ", "T" if thai[k - 1] and thai[k] else "L" if thai[k - 1] else "R"))
        found.sort()
    out: list[Place] = []
    last = 0
    capitals = unit.lower() != unit
    for end, i, mark, quote in found:
        k = bisect_left(starts, i)  # tokens before the mark: k - 1 is that which holds it
        a = starts[k - 1] if k else 0
        left_char = unit[i - 1] if i else ""
        script = _script(left_char) if left_char else "-"
        at, least = i, max(a, i - (2 if script in "hkt" else LONGEST_WORD)) if k else i
        while at > least and unit[at - 1] not in _NOT_IN_WORD and not unit[at - 1].isspace():
            at -= 1
        token = unit[at:i]
        previous = unit[max(starts[k - 2], tokens[k - 2][1] - LONGEST_WORD) : tokens[k - 2][1]] if k > 1 else ""
        r = bisect_right(starts, end)
        if end < n and not unit[end].isspace():
            gap, at = "n", end
        else:
            r = bisect_left(starts, end)
            at = starts[r] if r < len(starts) else n
            gap = "e" if at >= n else "s"
        first = unit[at] if at < n else ""
        kind = "e" if not first else "q" if first in _OPENERS else "w" if first.isalnum() else "." if first in _MARKS else ","
        follow = "e"
        p = at
        while p < n and (unit[p].isspace() or unit[p] in _OPENERS):
            p += 1
        right = ""
        if p < n:
            c = unit[p]
            sc = _script(c)
            follow = ("l" if c.islower() else "U" if c.isupper() else "9" if sc == "9" else "o") + sc
            if sc in "hkt":
                right = unit[p : p + 2]
            elif (m := _RIGHT_WORD.match(unit, p)) is not None:
                right = m.group(1)
        shape = _shape(token)
        dist = "0" if not _WORD.search(unit, last, end) else str(min(3, 1 + max(0, k - bisect_left(starts, last))))
        low = "c" if not capitals else "-" if kind != "w" or follow[0] != "l" else "l" if unit[last:i].islower() else "m"
        lone = "1" if k <= 2 and not unit[:a].strip(_OPENERS + " \t\r\n") else "0"
        left = _norm(token)
        words = ("1" + mark + left, f"2{mark}{_norm(previous)}{_END_OF_PREVIOUS.get(previous[-1:], '')} {left if len(left) == 1 else shape}", "3" + _norm(right))
        sure = 0
        if mark in _SURE and not quote and (follow[0] in "Uo" and gap != "n" or mark in "。！？।" and kind == "w"):
            sure = 1
        elif kind in "w," and follow[0] == "l" and capitals and low == "m" and mark == "." and "." not in right or gap == "n" and (kind == "," or follow[0] in "l9") and script not in "hk" or lone == "1" and shape == "9" and mark == ".":
            sure = -1
        out.append(Place(end, words, (mark, quote, follow, gap, kind, shape, script, low, lone), dist, sure))
        last = end
    return out


_SEEN: dict[str, tuple[int, int]] = {}


def _slots(word: str) -> tuple[int, int]:
    s = _SEEN.get(word)
    if s is None:
        if len(_SEEN) > _SEEN_MAX:
            _SEEN.clear()
        h = xxhash.xxh64_intdigest(word)
        s = _SEEN[word] = (h % BUCKETS, BUCKETS + (h >> 32) % BUCKETS)
    return s


_CJK_END = re.compile("[。！？」』”）]$")


def _units(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def joined(text: str) -> list[tuple[str, set[int]]]:
    """The units of ``text`` put together: (running text, ends of its known boundaries). Units that end without a mark
    (headings, list items) stand alone, without a known boundary."""
    out: list[tuple[str, set[int]]] = []
    run, ends = "", set()
    for a, b in _units(text):
        unit = text[a:b].strip()
        if not unit:
            continue
        closed = unit.rstrip("\"'”’»›“‘)]」』） \xa0\u202f")
        whole = closed[-1:] in _MARKS and unit.count('"') % 2 == 0 or bool(_THAI.search(unit.rsplit(None, 1)[-1]))
        if not whole:
            out.append((unit, set()))
            continue
        if run:
            ends.add(len(run))
            opening = unit.lstrip(_OPENERS)[:1]
            tight = _script(opening) in "hk" and _CJK_END.search(run) if opening else False
            run += ("" if tight or unit[0].isupper() and run[-1:] in ".!?" and xxhash.xxh32_intdigest(unit) % TIGHT == 0 else " ") + unit
        else:
            run = unit
        if len(run) > 2000:
            out.append((run, ends))
            run, ends = "", set()
    if run:
        out.append((run, ends))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by bucket: at joints, and elsewhere."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            for run, ends in joined(text):
                for p in places(run):
                    if p.plain[3] != "e" and p.sure >= 0:
                        v = seen.get((p.words, p.sure > 0))
                        if v is None:
                            v = seen[(p.words, p.sure > 0)] = [0, 0]
                        v[0 if p.end in ends else 1] += 1
        at: dict[int, list[int]] = {}
        for (words, sure), (x, y) in seen.items():
            slots = [s for w in words for s in _slots(w)]
            for s in [*slots, 2 * BUCKETS] if sure else slots:
                v = at.setdefault(s, [0, 0])
                v[0] += x
                v[1] += y
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([v[0] for v in at.values()], pa.int64()), pa.array([v[1] for v in at.values()], pa.int64())], ["slot", "joints", "others"])


#: Parts of the observation that make a feature together. 0 mark, 1 quote, 2 what follows, 3 gap, 4 its first character,
#: 5 shape of the word before, 6 its script, 7 letter case, 8 alone in the unit, 9 to 11 classes of the words.
TEMPLATES = [(0,), (1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (10,), (11,), (0, 2), (0, 2, 3), (0, 4), (5, 2), (5, 9), (9, 2), (10, 2), (10, 5), (11, 2), (9, 11), (10, 11, 5), (6, 0, 3), (1, 2), (1, 3, 4),
             (1, 6, 3), (7, 2, 0), (8, 5), (5, 11), (5, 2, 10), (3, 5, 2), (9, 10, 11), (1, 9), (1, 11)]
_GAPS = "0123"


class Model:
    """Word classes, weights of the boundary tag, and transitions [from, to, gap]."""

    def __init__(self, classes: np.ndarray | None = None, weights: dict | None = None, moves: np.ndarray | None = None):
        self.classes = np.full(2 * BUCKETS, -128, np.int8) if classes is None else classes
        self.weights = weights or {}
        self.moves = np.zeros((2, 2, len(_GAPS))) if moves is None else moves
        self._known: dict = {}
        self._score: dict = {}

    def _class(self, word: str) -> int:
        c = self._known.get(word)
        if c is None:
            if len(self._known) > _SEEN_MAX:
                self._known.clear()
            a, b = _slots(word)
            # A bucket's class holds its size as well, the smaller of the two tells more of the word itself.
            a, b = int(self.classes[a]), int(self.classes[b])
            size = lambda x: (x + 128) // 16
            c = a if size(a) <= size(b) else b
            c = self._known[word] = 99 if size(c) == 0 else (c + 128) % 16
        return c

    def features(self, p: Place) -> tuple:
        return (*p.plain, *map(self._class, p.words))

    def emission(self, p: Place) -> float:
        key = self.features(p)
        s = self._score.get(key)
        if s is None:
            if len(self._score) > _SEEN_MAX:
                self._score.clear()
            get = self.weights.get
            s = self._score[key] = sum(get((t, *[key[i] for i in f]), 0.0) for t, f in enumerate(TEMPLATES))
        return s


def classes_of(slots: np.ndarray, joints: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """The table of word classes, and the odds of a joint among places that are boundaries for sure (among all, where there are none)."""
    sure = slots == 2 * BUCKETS
    told = sure if joints[sure].sum() else ~sure
    odds = float((joints[told].sum() + 1) / (others[told].sum() + 1))
    table = np.full(2 * BUCKETS, -128, np.int8)
    s, e, m = slots[~sure], joints[~sure].astype(float), others[~sure].astype(float)
    ratio = np.log((e / odds + SMOOTH) / (m + SMOOTH))
    step = np.clip(np.round(ratio * 1.5), -9, 4) + 10
    size = np.where(e + m < RARE, 0, np.clip(np.log2(np.maximum(e + m, 1)) / 3 + 1, 1, 15)).astype(int)
    table[s] = np.clip(size * 16 + step - 128, -128, 127).astype(np.int8)
    return table, odds


def _marginals(e: np.ndarray, moves: np.ndarray, gaps: np.ndarray, allowed: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the boundary tag and of pairs of tags [place, sequence, from, to], all sequences side by side; the start counts as a boundary."""
    t, n = e.shape
    each = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2) * allowed
    psi = np.exp(np.moveaxis(moves, 2, 0))[gaps] * each[:, :, None, :]
    psi[~real] = np.eye(2)
    fwd, bwd = np.empty((t, n, 2)), np.ones((t, n, 2))
    f = np.tile([0.0, 1.0], (n, 1))
    for k in range(t):
        f = f[:, :1] * psi[k, :, 0] + f[:, 1:] * psi[k, :, 1]
        f = fwd[k] = f / f.sum(1, keepdims=True)
    for k in range(t - 2, -1, -1):
        b = psi[k + 1, :, :, 0] * bwd[k + 1, :, :1] + psi[k + 1, :, :, 1] * bwd[k + 1, :, 1:]
        bwd[k] = b / b.sum(1, keepdims=True)
    before = np.concatenate([np.tile([0.0, 1.0], (1, n, 1)), fwd[:-1]])
    two = before[..., None] * psi * bwd[:, :, None, :]
    two *= (real / two.sum((2, 3)))[..., None, None]
    return two[..., 1].sum(2), two


def train(texts: list[str], classes: np.ndarray, odds: float, rounds: int = ROUNDS) -> Model:
    """The model fitted on the sample ``texts``."""
    model = Model(classes)
    index: dict[tuple, int] = {}
    sequences, labels = [], []
    for text in texts:
        for run, ends in joined(text):
            p = places(run)
            for at in range(0, len(p), STRETCH):
                sequences.append(p[at : at + STRETCH])
                labels.append([2 if x.plain[3] == "e" else 1 if x.end in ends else 0 for x in p[at : at + STRETCH]])
    if not sequences:
        return model
    n, t, k = len(sequences), max(map(len, sequences)), len(TEMPLATES)
    length = np.array([len(s) for s in sequences])
    # Equal observations are scored once.
    which, gaps, kind, sure = np.zeros((t, n), np.int64), np.zeros((t, n), np.int64), np.full((t, n), -1), np.zeros((t, n))
    rows: list[list[int]] = []
    number: dict = {}
    for i, (s, l) in enumerate(zip(sequences, labels)):
        for j, p in enumerate(s):
            key = model.features(p)
            at = number.get(key)
            if at is None:
                at = number[key] = len(rows)
                rows.append([index.setdefault((q, *[key[x] for x in f]), len(index)) for q, f in enumerate(TEMPLATES)])
            which[j, i], gaps[j, i], kind[j, i], sure[j, i] = at, _GAPS.index(p.gap), l[j], p.sure
    ids, size = np.array(rows), len(index)
    # Joints against all other places; whether a blank follows was chosen for the joints, so it tells nothing here.
    shown = [q for q, f in enumerate(TEMPLATES) if 3 not in f]
    x, m = ids[:, shown], len(rows)
    ones, all_ = np.bincount(which[kind == 1], minlength=m), np.bincount(which[(kind == 0) | (kind == 1)], minlength=m)
    if not ones.any():
        return model
    w = _ascend(lambda w: np.bincount(x.ravel(), np.repeat(ones - all_ / (1 + np.exp(-w[x].sum(1))), len(shown)), size) / all_.sum(), size, rounds, PRIOR / all_.sum())
    p_boundary = (np.exp(np.minimum(w[x].sum(1), 30)) / odds)[which]
    tag = np.full((t, n), -1)
    tag[p_boundary < SURE_INSIDE] = 0
    tag[p_boundary > SURE_BOUNDARY] = 1
    tag[sure < 0], tag[sure > 0] = 0, 1
    tag[kind >= 1] = 1
    allowed = np.stack([tag != 1, tag != 0], 2)
    free = np.ones_like(allowed)
    real = np.arange(t)[:, None] < length[None, :]
    g = len(_GAPS)
    many = length.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        e, moves = w[ids].sum(1)[which], w[size:].reshape(2, 2, g)
        one_a, two_a = _marginals(e, moves, gaps, allowed, real)
        one_b, two_b = _marginals(e, moves, gaps, free, real)
        up = np.bincount(ids.ravel(), np.repeat(np.bincount(which[real], (one_a - one_b)[real], m), k), size)
        side = np.stack([np.bincount(gaps[real], (two_a - two_b)[:, :, a, b][real], g) for a in (0, 1) for b in (0, 1)])
        return np.concatenate([up, side.ravel()]) / many

    w = _ascend(gradient, size + 4 * g, rounds, PRIOR / many)
    weights = {key: float(w[i]) for key, i in index.items() if abs(w[i]) > 1e-3}
    return Model(classes, weights, w[size:].reshape(2, 2, g))


def _ascend(gradient, size: int, rounds: int, ridge: float) -> np.ndarray:
    """Adam on a concave likelihood with a ridge."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for r in range(1, rounds + 1):
        d = gradient(w) - ridge * w
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w = w + RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return w


def fit(documents: DataFrame, rows: int = SAMPLE, longest: int = SAMPLE_CHARS) -> Model:
    """Counts of words over all documents, at most ``2 * BUCKETS`` rows; weights from at most ``rows`` documents of at most ``longest`` characters."""
    counts = documents.select("text").mapInArrow(_count, "slot int, joints bigint, others bigint").groupBy("slot").agg(F.sum("joints").alias("joints"), F.sum("others").alias("others")).toArrow()
    classes, odds = classes_of(*[counts.column(c).to_numpy() for c in ("slot", "joints", "others")])
    some = documents.where(F.length("text") <= longest).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(rows).collect()
    return train([r.text for r in some], classes, odds)


def decode(found: list[Place], model: Model) -> list[int]:
    """Viterbi: the best sequence of inside and boundary tags, as the boundary positions."""
    inside, boundary = -math.inf, 0.0
    back: list[tuple[int, int]] = []
    moves = model.moves
    for p in found:
        g = ord(p.gap) - 48
        e = model.emission(p)
        a, b = inside + moves[0, 0, g], boundary + moves[1, 0, g]
        c, d = inside + moves[0, 1, g], boundary + moves[1, 1, g]
        back.append((0 if a >= b else 1, 0 if c >= d else 1))
        inside, boundary = max(a, b), max(c, d) + e
    ends: list[int] = []
    tag = 1 if boundary > inside else 0
    for k in range(len(found) - 1, -1, -1):
        if tag:
            ends.append(found[k].end)
        tag = back[k][tag]
    return ends[::-1]


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for at, stop in _units(text):
        unit = text[at:stop]
        a = 0
        for b in [*decode(places(unit), model), len(unit)]:
            piece = unit[a:b]
            body = piece.strip()
            if body:
                start = at + a + len(piece) - len(piece.lstrip())
                out.append((start, start + len(body)))
            a = b
    return out


_MODELS: dict[int, Model] = {}


def _split(shared, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _MODELS:
            _MODELS.clear()
            _MODELS[number] = Model(*shared.value)
        model = _MODELS[number]
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in sentences(text, model):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_pos", "end_pos"])

    return run


def split_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of every document."""
    model = fit(documents)
    # The table has a fixed size, and the weights no more entries than the places of the sample have features.
    shared = documents.sparkSession.sparkContext.broadcast((model.classes, model.weights, model.moves))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(_split(shared, shared._jbroadcast.id()), "doc_id bigint, start_pos bigint, end_pos bigint")
