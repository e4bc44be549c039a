"""Sentence units of documents in many languages, with trained boundary decisions.

Every mark that may end a sentence is a candidate. A maximum-entropy model decides
it from its neighbourhood: the token before it (identity, length, case, digits,
how often it stands at a sure boundary), the mark, the gap, the class and case of
what follows, the script and the state of quotations. The model is trained on
reliable boundaries of a bounded sample: candidates before a wide gap, a lost
space or the end of a line are sure boundaries; candidates before a lower-case word,
and after tokens that never once stand at a sure boundary, are sure not to be.

Layout comes first: in html and text documents each line feed ends a unit, in pdf
documents a blank line does. List items are one unit. A quotation that is open
hides the marks in it. Thai sentences are parted by white space.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.llm.sampling import hashed_sample
from lexlode.session import spread

SAMPLE_DOCS = 2000
NEVER = 200
# Abbreviations that end in a full stop and rarely end a sentence.
ABBREVIATIONS = frozenset("""
mr mrs ms dr prof st jr sr fig figs sec no nos vs al ltd inc co corp incl approx e.g i.e a.m p.m cf etc dept est vol pp p
nr abb ca z b d h u a hr fr bzw bsp evtl ggf usw vgl tel str
env ex art m mme mm mlle av
sra srta aprox núm pág ud uds ej
инж г т е стр рис см им ул др пр тыс млн
डॉ श्री د
""".split())
_ABBR = ABBREVIATIONS
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}
_EVENT = re.compile(r"[.!?。！？।؟॥]+|[“”„\"«»「」『』]")
_ITEM = re.compile(r"\s*(?:[-*•‣◦–]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))\s")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile("(?<=[฀-๿\\d»”\"])\\s+(?=[฀-๿\\d«“\"])")
_WORD = re.compile(r"[^\s(\[{“„«\"'‘¿¡「『]+$")
_IDENTIFIER = re.compile(r"[a-z]+(?:_\w|[A-Z]|-?\d)")
_FULL = "。！？।॥؟"


def _kind(text: str, at: int, end: int) -> str:
    """Class of what follows a gap; an identifier may open a sentence in lower case."""
    c = text[at] if at < end else ""
    if not c:
        return "E"
    if c.islower() and _IDENTIFIER.match(text, at, end):
        return "U"
    if c.isalpha():
        return "U" if c.isupper() or c.istitle() else "l" if c.islower() else "o"
    if c.isdigit():
        return "d"
    return "q" if c in "“„«\"「『¿¡([‘" else "-" if c in "-–—" else "p"


def _script(c: str) -> str:
    o = ord(c) if c else 0
    if o < 0x250:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x2E80 <= o < 0xA4D0 or 0xF900 <= o < 0xFAFF or 0xFF00 <= o < 0xFFF0:
        return "wide"
    return "other"


def candidates(text: str, start: int, end: int):
    """Yield (end of unit, key, gap) of each candidate in a block; the key is what the model sees."""
    close, colon, first, unit = "", False, False, start
    for m in _EVENT.finditer(text, start, end):
        s, e = m.span()
        c = text[s]
        if c in _OPEN or c in "”»」』":
            if close:
                if c != close:
                    continue
                close = ""
                i = s - 1
                while i > start and text[i].isspace():
                    i -= 1
                if text[i] not in ".!?。！？।؟…":
                    continue
                kind, token, mark = "Q", "", text[i]
                before = text[i]
            elif c in _OPEN and text.find(_OPEN[c], e, end) >= 0:
                i = s - 1
                while i >= start and text[i].isspace():
                    i -= 1
                close, colon, first = _OPEN[c], i >= start and text[i] in ":：", i < unit
                continue
            else:
                continue
        elif close:
            continue
        else:
            kind, mark = "T", c if e - s == 1 else "..." if m[0].startswith("..") else m[0][-1]
            while e < end and text[e] in ")]）":
                e += 1
            before = text[s - 1] if s > start else ""
            w = _WORD.search(text, max(start, s - 24), s) if mark == "." else None
            token = w[0] if w else ""
            head, dot, tail = token.rpartition(".")
            if dot and len(head) > 2 and tail[:1].isupper():
                token = tail
        g = e
        while g < end and text[g].isspace():
            g += 1
        nxt = text[g] if g < end else ""
        if g == e and nxt:
            if mark == "." and kind == "T" and not (nxt.isupper() and before.islower() and len(token) > 2 and "/" not in token or nxt in "“„«¿¡「"):
                continue
            if mark in "!?" and kind == "T" and nxt in ".,;:)…":
                continue
        gap = text[e:g]
        shape = "" if not token else "1" if len(token) == 1 else "d" if token[-1].isdigit() else "U" if token[0].isupper() else "l"
        key = (kind, mark, token.lower() if len(token) <= 8 else "~", shape, g > e, _kind(text, g, end), kind == "Q" and colon, kind == "Q" and first,
               _script(before) if before.isalpha() or kind == "Q" or before in "»”\"" else _script(nxt) if nxt.isalpha() else "latin")
        yield e, g, key, gap
        if not nxt or gap:
            unit = g


def blocks(text: str, doc_type: str | None):
    """(start, end) of the stretches in which layout puts no further boundary."""
    pos = 0
    if doc_type == "pdf":
        for m in _BLANK.finditer(text):
            yield pos, m.start()
            pos = m.end()
        yield pos, len(text)
        return
    while True:
        n = text.find("\n", pos)
        if n < 0:
            yield pos, len(text)
            return
        yield pos, n
        pos = n + 1


def _thai(text: str, s: int, e: int) -> bool:
    return bool(_THAI.search(text, s, e))


# ---- the model --------------------------------------------------------------

def features(key: tuple, rate: dict[str, int]) -> list[str]:
    kind, mark, token, shape, gap, nxt, colon, first, script = key
    m = "full" if mark in _FULL else mark
    f = ["bias", f"m={m}", f"n={nxt}", f"m={m},n={nxt}", f"k={kind},n={nxt}", f"s={script},k={kind},m={m}", f"gap={gap},n={nxt}"]
    if kind == "Q":
        f += [f"colon={colon}", f"first={first},n={nxt}", f"s={script},colon={colon}"]
    if m == ".":
        r = rate.get(token)
        f += [f"shape={shape}", f"shape={shape},n={nxt}", f"len={min(len(token), 5)}", f"rate={r}", f"rate={r},n={nxt}",
              f"abbr={token in _ABBR},n={nxt}", f"abbr={token in _ABBR}", f"inner={'.' in token}", f"t={token}"]
    return f


def _prior():
    """Pseudo-examples that hold where the sample is silent; each counts little."""
    for script, up, low in (("latin", "U", "l"), ("cyrillic", "U", "l"), ("wide", "o", ""), ("other", "o", "")):
        for n in (up, "q", "d", "E"):
            yield ("T", ".", "~", "l", True, n, False, False, script), 1
            for mark in "!?":
                yield ("T", mark, "", "", True, n, False, False, script), 1
            yield ("T", "。", "", "", False, n, False, False, script), 1
        for token in ("it", "old", "here", "table", "system", "~"):
            for n in (up, "q", "d", "E"):
                yield ("T", ".", token, "l", True, n, False, False, script), 1
            yield ("T", ".", token, "l", False, up, False, False, script), 1
            yield ("T", ".", token.title(), "U", True, up, False, False, script), 1
        if low:
            for mark in ".!?":
                yield ("T", mark, "~" if mark == "." else "", "l" if mark == "." else "", True, low, False, False, script), 0
            yield ("T", "...", "", "", True, low, False, False, script), 0
            yield ("T", "...", "", "", True, up, False, False, script), 1
            for mark in ".!?":
                for n, y in ((up, 1), ("q", 1), ("E", 1), (low, 0), ("-", 0), ("p", 0)):
                    yield ("Q", mark, "", "", True, n, False, n != up, script), y
        else:
            for mark in ".!?。！？؟।":
                for n in ("o", "q", "d"):
                    for gap in (True, False):
                        yield ("Q", mark, "", "", gap, n, True, False, script), 1
                        yield ("Q", mark, "", "", gap, n, False, n == "o", script), 0 if n != "q" else 1
        for a in sorted(_ABBR):
            for n in (up, "d"):
                yield ("T", ".", a, "1" if len(a) == 1 else "U", True, n, False, False, script), 0
    for _ in range(3):
        yield ("T", ".", "3.9", "d", True, "U", False, False, "latin"), 1
    for n in ("U", "l"):
        yield ("T", ".", "4", "1", True, n, False, False, "latin"), 0
        yield ("T", ".", "14", "d", True, n, False, False, "latin"), 0


class Model:
    """Weights of a binary maximum-entropy model over discrete keys, with a memo of its decisions."""

    def __init__(self, weights: dict[str, float], rate: dict[str, int]):
        self.weights, self.rate, self.memo = weights, rate, {}

    def __call__(self, key: tuple) -> bool:
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            w = self.weights
            got = self.memo[key] = sum(w.get(f, 0.0) for f in features(key, self.rate)) > 0
        return got


def fit(counts: list[tuple[tuple, int, int]], l2: float = 0.05, steps: int = 25) -> Model:
    """Train from (key, times seen, times seen at a sure boundary).

    Newton's method on the log-likelihood with an L2 penalty; the same counts give
    the same weights.
    """
    seen, sure = Counter(), Counter()
    for key, n, y in counts:
        if key[1] == "." and key[0] == "T":
            seen[key[2]] += n
            sure[key[2]] += y
    rate = {t: 0 if not sure[t] else 1 + min(3, int(math.log2(1 + 64 * sure[t] / n))) for t, n in seen.items() if n >= NEVER and t != "~"}
    rows: list[tuple[list[str], float, int]] = [(features(k, rate), 2.0, y) for k, y in _prior()]
    for key, n, y in counts:
        f = features(key, rate)
        weight = lambda c: min(50.0, math.sqrt(c))
        if y:
            rows.append((f, weight(y), 1))
        never = key[0] == "T" and key[1] == "." and rate.get(key[2]) == 0
        if n > y and key[4] and (key[5] == "l" or never):
            rows.append((f, weight(n - y), 0))
    names = {x: i for i, x in enumerate(sorted({x for f, _, _ in rows for x in f}))}
    X = np.zeros((len(rows), len(names)))
    for r, (f, _, _) in enumerate(rows):
        X[r, [names[x] for x in f]] = 1
    w, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    beta = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        grad = X.T @ (w * (y - p)) - l2 * beta
        hess = (X * (w * p * (1 - p))[:, None]).T @ X + l2 * np.eye(len(names))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return Model({x: float(beta[i]) for x, i in names.items()}, rate)


def _evidence(batches):
    """Counts of candidate keys in a sample: how often seen, how often at a sure boundary."""
    n, sure = Counter(), Counter()
    for b in batches:
        for text, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for s, e in blocks(text, kind):
                if not _ITEM.match(text, s, e):
                    for _, _, key, gap in candidates(text, s, e):
                        n[key] += 1
                        sure[key] += key[5] == "E" or len(gap) > 1 and "\n" not in gap or gap == "\xa0" or (not gap and key[1] == ".")
    keys = sorted(n, key=repr)
    yield pa.RecordBatch.from_pydict({"key": [repr(k) for k in keys], "n": [n[k] for k in keys], "sure": [sure[k] for k in keys]},
                                     schema=pa.schema([("key", pa.string()), ("n", pa.int64()), ("sure", pa.int64())]))


def train(docs: DataFrame, id_col: str, text_col: str, type_col: str, sample: int = SAMPLE_DOCS) -> Model:
    """Fit the model on about ``sample`` documents, those whose ids hash lowest."""
    from ast import literal_eval

    picked = hashed_sample(docs.select(id_col, text_col, type_col), id_col, sample).where(F.col(text_col).isNotNull()).select(text_col, type_col)
    rows = picked.mapInArrow(_evidence, "key string, n long, sure long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")).orderBy("key").collect()
    return fit([(literal_eval(r.key), r.n, r.sure) for r in rows])


# ---- units ------------------------------------------------------------------

def units(text: str, doc_type: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentence units of a text as (start, end), without surrounding white space."""
    out: list[tuple[int, int]] = []

    def add(s: int, e: int) -> None:
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip())
        if left < len(piece):
            out.append((s + left, s + len(piece.rstrip())))

    for s, e in blocks(text, doc_type):
        if s >= e or text[s:e].isspace():
            continue
        if _ITEM.match(text, s, e):
            add(s, e)
            continue
        cuts = {end for end, _, key, _ in candidates(text, s, e) if model(key)}
        if _thai(text, s, e):
            cuts |= {m.start() for m in _THAI_GAP.finditer(text, s, e)}
        for c in sorted(cuts):
            add(s, c)
            s = c
        add(s, e)
    return out


def _units(model: Model):
    def run(batches):
        for b in batches:
            at, starts, ends = [], [], []
            for i, (text, kind) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                got = units(text, kind, model)
                at += [i] * len(got)
                starts += [s for s, _ in got]
                ends += [e for _, e in got]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                                             names=["id", "start_char", "end_char"])
    return run


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "doc_type", sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per sentence unit: id, start_char, end_char (code points, end exclusive).

    A null, empty or blank text has no unit, a null type counts as text, repeated
    rows give their units again, other columns are not read. Units keep the order
    of the text and do not overlap. No shuffle besides the sample's.
    """
    model = train(docs, id_col, text_col, type_col, sample)
    src = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(type_col).alias("kind")).where("text is not null"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_units(model), f"id {kind}, start_char int, end_char int").withColumnRenamed("id", id_col)
