"""Defects of question and answer pairs, from clause tags of a conditional random field.

An answer is cut into clauses (lines, then sentences). A linear-chain conditional
random field tags each clause as answer, refusal, echo, foreign or unfinished from
its likeness to the query, its wording, its language against the query's and how
it ends. The share of the answer's letters under each tag then gives the pair's
defect. The field is trained on clause sequences made from a bounded sample of
the pairs themselves: echoes of their queries, clauses of pairs in another
language, clauses cut off at a random place, refusals, and whole answers.

The wording enters as the logit of a model over hashed character n-grams, in which
words of the query are one sign. It starts from the labelled texts of ``pair_texts`` against
the clauses of the sample, and is fitted again, each time with the clauses that a model
of other clauses took for refusals on the other side. The field is trained on such
logits of models that did not see the clause.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.llm.pair_texts import CLOSINGS, COURTESIES, SOUND, WORDS, labelled, refusal_examples
from lexlode.llm.sampling import hashed_sample
from lexlode.llm.sentences import ABBREVIATIONS, candidates, fit
from lexlode.llm.shingles import BASE, mix
from lexlode.session import cut, spread

SAMPLE_PAIRS, SAMPLE_CHARS, WINDOW = 1500, 20_000, 16
GRAMS, BITS, FOLDS, OFTEN, LOW = 6, 17, 4, 3, (0.1, 0.2, 0.2)
_STEPS = (-5, -3, -1, 0, 1, 3, 5)
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# Answers that say nothing, once marks and white space are gone.
PLACEHOLDERS = frozenset("n/a na none null nil nan tbd todo blank empty noanswer answer nbsp p undefined missing unknown keineantwort sinrespuesta".split())
# Sound answers that look odd, and ends that are none, for training.
ODD = ("v4.4", "18.1", "120 ms", "Yes.", "- x1\n- x2", "1. x1\n2. x2", "```\nrun(x)\n```", "42", "X7.", "- 3.5 MB")
UNFINISHED = ("1. x1\n2.", "```\nrun(x, ", "- x1\n-", "x1 (", "x1,")
LANGUAGES = {
    "en": "english|englisch|anglais|inglés|英語|英文|英语|английск|अंग्रेज|الإنجليزية|อังกฤษ", "de": "german|deutsch|allemand|alemán|ドイツ語|德语|немецк|जर्मन|الألمانية|เยอรมัน",
    "fr": "french|französisch|français|francés|フランス語|法语|французск|फ़्रेंच|फ्रेंच|الفرنسية|ฝรั่งเศส", "es": "spanish|spanisch|espagnol|español|スペイン語|西班牙语|испанск|स्पेनिश|الإسبانية|สเปน",
    "zh": "chinese|chinesisch|chinois|chino|中国語|中文|китайск|चीनी|الصينية|จีน", "ja": "japanese|japanisch|japonais|japonés|日本語|日语|японск|जापानी|اليابانية|ญี่ปุ่น",
    "ru": "russian|russisch|russe|ruso|ロシア語|俄语|русск|रूसी|الروسية|รัสเซีย", "ar": "arabic|arabisch|arabe|árabe|アラビア語|阿拉伯语|арабск|अरबी|العربية|อาหรับ",
    "hi": "hindi|ヒンディー|印地语|хинди|हिन्दी|हिंदी|الهندية|ฮินดี", "th": "thai|thailändisch|thaï|tailandés|タイ語|泰语|тайск|थाई|التايلاندية|ภาษาไทย",
}
_ASKS = {k: re.compile(v.casefold()) for k, v in LANGUAGES.items()}
_ASKS_ANY = re.compile("|".join(LANGUAGES.values()).casefold())
_WORDS: dict[str, list[str]] = {}
for _lang, _list in WORDS.items():
    for _w in _list.split():
        _WORDS.setdefault(_w, []).append(_lang)
_SCRIPTS = ((re.compile("[぀-ヿ]"), "ja"), (re.compile("[一-鿿]"), "zh"), (re.compile("[Ѐ-ӿ]"), "ru"), (re.compile("[؀-ۿ]"), "ar"),
            (re.compile("[ऀ-ॿ]"), "hi"), (re.compile("[฀-๿]"), "th"), (re.compile("[가-힣ᄀ-ᇿ]"), "ko"), (re.compile("[Ͱ-Ͽ]"), "el"), (re.compile("[֐-׿]"), "he"), (re.compile("[A-Za-zÀ-ɏ]"), "latin"))
_DENSE = re.compile("[぀-ヿ一-鿿]")
_TOKEN = re.compile(r"[^\W\d_]+")
_NOT = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile("\x01|(?:[^\\W_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31-\u0e3a\u0e47-\u0e4e])+")
_KANA = re.compile("[぀-ヿ]")
_TAG = re.compile(r"<[^>]*>|&\w+;")
_LETTER = re.compile(r"[^\W_]")
_CITE = re.compile(r"(\s*\[\d+\])+\s*$")
_LEAD = re.compile(r"^\W*(q|question|query|answer|a|you asked|frage|pregunta|вопрос)\s*[:：]\s*", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])(?:\s+|$)")
_VALUE = re.compile(r"^(v?\d[\d.,:/ ]*(?:\s?(?:ms|s|%|mb|gb|kb|rows?|m|km|h|min))?|yes|no|ja|nein|oui|non|sí|да|нет|はい|いいえ|是|否)$", re.I)
_SAID = re.compile(r"[\"“„«「][^\"“”„«»「」]*[\"”“»」]")
_STOP = re.compile(r"[.!?。！？।؟…][\s\"”“»」』)\]]*$")
_MODEL = fit([])


def norm(text: str) -> str:
    """Letters and digits of a text, in lower case."""
    return _NOT.sub("", text.casefold())


def language(text: str, japanese: bool = False) -> str:
    """Language of a short text by script and function words; "" if nothing tells."""
    return next(iter(languages(text, japanese)), "")


@lru_cache(maxsize=50_000)
def languages(text: str, japanese: bool = False) -> tuple[str, ...]:
    """All languages that a short text fits equally well."""
    if not text or max(text) <= "\u024f":
        most, name = 1, "latin"
    else:
        counts = [(len(r.findall(text)) * (3 if name in ("ja", "zh", "ko") else 1), name) for r, name in _SCRIPTS]
        most, name = max(counts)
    if not most:
        return ()
    if name in ("zh", "ja"):
        return ("ja",) if japanese or counts[0][0] * 12 > most else ("zh",)
    if name != "latin":
        return (name,)
    votes: dict[str, float] = {}
    for w in filter(_WORDS.__contains__, _TOKEN.findall(text.lower())):
        for lang in _WORDS[w]:
            votes[lang] = votes.get(lang, 0.0) + 1 / len(_WORDS[w])
    best = max(votes.values(), default=0.0)
    return tuple(k for k in WORDS if votes.get(k) == best) if best > 0 else ()


def clauses(answer: str) -> list[str]:
    """Clauses of an answer: fenced code as one, else lines, else sentences."""
    out, fence = [], None
    for line in _CITE.sub("", answer).split("\n"):
        if line.lstrip().startswith("```"):
            if fence is None:
                fence = [line]
            else:
                out.append("\n".join([*fence, line]))
                fence = None
        elif fence is not None:
            fence.append(line)
        elif line.strip():
            if _ITEM.match(line):
                out.append(line)
                continue
            s = 0
            for e, _, key, _ in candidates(line, 0, len(line)):
                if _MODEL(key):
                    out.append(line[s:e])
                    s = e
            out.append(line[s:])
    if fence is not None:
        out.append("\n".join(fence))
    return [c for c in out if c.strip()]


def likeness(clause: str, query: str) -> float:
    """Share of the longer normalised text that is common, counted by pairs of characters; repeats of the query count as it."""
    return _likeness(norm(_LEAD.sub("", clause)), norm(query))


def _likeness(a: str, b: str, floor: float = 0.0) -> float:
    """The likeness of two normalised texts, or 0 if it is below ``floor``."""
    if not a or not b:
        return 0.0
    n = round(len(a) / len(b))
    if n > 1:
        b *= n
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)):
        return 0.0
    y = _pairs_of(b)
    if floor and sum(map(a.__contains__, y)) < floor * len(y):  # it cannot be more than this share of the query's pairs
        return 0.0
    x = set(map("".join, zip(a, a[1:])))
    return len(x & y) / max(1, len(x), len(y))


@lru_cache(maxsize=1024)
def _pairs_of(t: str) -> frozenset[str]:
    return frozenset(map("".join, zip(t, t[1:])))


def ending(clause: str, ends_known: bool) -> str:
    """How a last clause ends: stop, item, value, open (in a fence, quotation or bracket) or cut."""
    t = _CITE.sub("", clause).rstrip()
    if t.startswith("```") or t.endswith("```"):
        return "stop" if t.count("```") > 1 and t.endswith("```") else "open"
    m = _ITEM.match(t)
    if m:
        return "open" if not t[m.end():].strip() else "item"
    if _VALUE.match(t.strip()):
        return "value"
    if t.endswith(("…", "...")) or re.search(r"[,;:(\[{«„“「、，：-]$", t) and not (t.endswith("“") and "„" in t):
        return "cut"
    if t.count('"') % 2 or any(t.count(o) > t.count(c) for o, c in ("()", "«»", "「」")) or t.count("„") > t.count("“"):
        return "open"
    if _STOP.search(t):
        w = re.search(r"([^\W_]+(?:\.[^\W\d_]+)*)\.$", t)
        short = w and (w[1].lower() in ABBREVIATIONS and not w[1].lower() in ("no", "art", "tel", "co", "p.m", "a.m") or len(w[1]) == 1 and w[1].isalpha())
        return "cut" if short or re.search(r"(?<![\w.])\d+\.$", t) and len(t) > 12 else "stop"
    if _SCRIPTS[5][0].search(t[-1:]):
        return "stop" if ends_known else "cut"
    return "cut"


def masked(clause: str, query_words: frozenset[str]) -> str:
    """What the wording is judged by: lower case, words of the query and what is quoted within it as one sign."""
    own = _SAID.sub(" \x01 ", clause)
    own = own if len(own.strip()) > 8 else clause
    return " " + " ".join("_" if w in query_words or w == "\x01" else w for w in _MARKED.findall(own.casefold())) + " "


class Wording:
    """Logits of a linear model over hashed character n-grams of masked clauses."""

    def __init__(self, weights: np.ndarray, bias: float = 0.0):
        self.weights, self.bias = weights, bias

    @staticmethod
    def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams of each text, and the text that each belongs to."""
        if not texts:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        sizes = np.array([len(t) for t in texts])
        owner, end = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h, ids, owners = c, [], []
        for width in range(2, GRAMS + 1):  # each width goes on from the one before
            h = h[:-1] * BASE + c[width - 1 :]
            inside = np.flatnonzero(np.arange(width, len(h) + width) <= end[: len(h)])
            ids.append((mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[inside])
        return np.concatenate(ids), np.concatenate(owners)

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, owners = self.grams(texts)
        n = np.bincount(owners, minlength=len(texts))
        return np.bincount(owners, weights=self.weights[ids], minlength=len(texts)) / np.sqrt(np.maximum(n, 1)) + self.bias

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = 60, rate: float = 0.6, l2: float = 2e-2) -> "Wording":
        """Weighted logistic regression by full-batch Adam."""
        ids, owners = cls.grams(texts)
        scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(texts)), 1))
        own = cls(np.zeros(1 << BITS))
        m, v, mb, vb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
        for step in range(1, steps + 1):
            z = np.bincount(owners, weights=own.weights[ids], minlength=len(texts)) * scale + own.bias
            err = weights * (labels - 1 / (1 + np.exp(-z)))
            g = np.bincount(ids, weights=(err * scale)[owners], minlength=1 << BITS) - l2 * own.weights
            gb = err.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            up, down = 1 - 0.9**step, 1 - 0.999**step
            own.weights = own.weights + rate * (m / up) / (np.sqrt(v / down) + 1e-6)
            own.bias += 0.2 * rate * (mb / up) / (np.sqrt(vb / down) + 1e-6)
        return own


def _balanced(labels: np.ndarray, doubt: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Weights by which refusals and sound clauses of a language count alike, and a language as much as its share of refusals."""
    weights = np.zeros(len(labels))
    for g in np.unique(group):
        of = (group == g) & ~doubt
        good, bad = of & (labels > 0), of & (labels == 0)
        weights[good] = 1.0
        weights[bad] = max(1, good.sum()) / max(1, bad.sum())
    return weights


def train_wording(clauses_: list[str], folds: int = FOLDS) -> tuple[Wording, list[Wording], dict[str, int], set[str]]:
    """Model of refusing wordings from the labelled texts and masked clauses of the sample.

    Clauses of the sample count as sound, those met OFTEN times as neither; after each round those that a model of other
    clauses gives a probability above 0.5 count as refusals and those above a bound as
    neither, so that the next models judge them unseen; the bound rises from 0.02 to 0.2.
    Equal texts count once. Returns the model of all texts, one without each fold, the
    fold of each text, and the clauses that were taken for refusals or neither.
    """
    good = list(dict.fromkeys(masked(t, frozenset()) for t in refusal_examples() + labelled(CLOSINGS) + labelled(COURTESIES)))
    bad = list(dict.fromkeys(masked(t, frozenset()) for t in labelled(SOUND)))
    own = list(dict.fromkeys(t for t in clauses_ if t.strip(" _")))
    texts = list(dict.fromkeys(good + bad + own))
    fixed = len(good) + len(bad)
    fold = np.arange(len(texts)) % folds
    group = np.array([next(iter(languages(t)), "") for t in texts])
    labels = np.array([1.0] * len(good) + [0.0] * (len(texts) - len(good)))
    times = Counter(clauses_)
    often = np.array([i >= fixed and times[t] >= OFTEN for i, t in enumerate(texts)])
    doubt = often
    parts: list[Wording] = []
    for low in LOW:
        weights = _balanced(labels, doubt, group)
        parts = [Wording.fit([t for t, f in zip(texts, fold) if f != k], labels[fold != k], weights[fold != k]) for k in range(folds)]
        p = np.zeros(len(texts))
        for k in range(folds):
            p[fold == k] = 1 / (1 + np.exp(-parts[k].logits([t for t, f in zip(texts, fold) if f == k])))
        p[:fixed] = labels[:fixed]
        labels, doubt = (p > 0.5).astype(float), (p <= 0.5) & ((p > low) | often)
    taken = {t for t, x in zip(texts[fixed:], ((labels > 0) | doubt & ~often)[fixed:]) if x}
    return Wording.fit(texts, labels, _balanced(labels, doubt, group)), parts, dict(zip(texts, fold.tolist())), taken


Key = tuple[str, str, str, bool, int]


def clause_features(query: str, answer: str, ends_known: bool) -> tuple[list[str], list[tuple[str, str, str, bool]], list[str], list[str]]:
    """Clauses of an answer; of each its echo, language, ending and whether it is first; its masked text; its letters."""
    parts = clauses(answer)
    ja = not answer.isascii() and bool(_KANA.search(answer))
    want, asked, words = _query(query)
    out, texts, letters = [], [], []
    last = len(parts) - 1
    for i, c in enumerate(parts):
        plain = norm(_LEAD.sub("", c) if ":" in c or "：" in c else c)
        like = _likeness(plain, asked, 0.74)
        lang = languages(c, ja) if not c.startswith("```") else ()
        foreign = "unknown" if not lang or not want else "same" if not want.isdisjoint(lang) else "other"
        out.append(("full" if like >= 0.97 else "near" if like >= 0.74 else "no", foreign, ending(c, ends_known) if i == last else "inner", i == 0))
        texts.append(masked(c, words))
        letters.append(plain)
    return parts, out, texts, letters


@lru_cache(maxsize=4096)
def _query(query: str) -> tuple[frozenset[str], str, frozenset[str]]:
    """Languages that an answer may have, letters and words of a query."""
    low = query.casefold()
    named = {k for k, r in _ASKS.items() if r.search(low)} if _ASKS_ANY.search(low) else set()
    return frozenset(({language(query, bool(_KANA.search(query)))} | named) - {""}), norm(query), frozenset(_MARKED.findall(low))


def with_wording(key: tuple[str, str, str, bool], logit: float) -> Key:
    """What is known of a clause, with the step of its wording's logit."""
    return (*key, bisect(_STEPS, logit))


@lru_cache(maxsize=8192)
def features(key: Key) -> tuple[str, ...]:
    """Features of a clause: all that is known of it, and pairs of it."""
    echo, foreign, end, first, step = key
    return ("bias", f"echo={echo}", f"lang={foreign}", f"end={end}", f"end={end},echo={echo}", f"first={first}", f"lang={foreign},echo={echo}", f"end={end},lang={foreign}",
            f"refusal={step}", f"refusal={step},echo={echo}", f"refusal={step},lang={foreign}", f"refusal={step},first={first}")


# ---- the field --------------------------------------------------------------

class Field:
    """A linear-chain conditional random field over clause features."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move, self.known = names, emit, move, {}

    def emission(self, key: Key) -> np.ndarray:
        """Score of each tag for a clause; clauses of which the same is known share it."""
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self.emit[[self.names[x] for x in features(key) if x in self.names]].sum(axis=0)
        return got

    def tag(self, answers: list[list[Key]]) -> list[list[int]]:
        """Most likely tag sequence of each answer, all answers side by side."""
        lengths = np.array([len(a) for a in answers], dtype=int)
        if not lengths.sum():
            return [[] for _ in answers]
        emitted = np.array([self.emission(k) for a in answers for k in a])
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        best, back = np.zeros((len(answers), len(TAGS))), []
        some = sizes > 0
        best[some] = emitted[start[some]]
        for t in range(1, int(sizes[0])):
            n = int((sizes > t).sum())
            total = best[:n, :, None] + self.move
            back.append(total.argmax(axis=1))
            best[:n] = total.max(axis=1) + emitted[start[:n] + t]
        out: list[list[int]] = [[] for _ in answers]
        last = best.argmax(axis=1)
        for k, (i, n) in enumerate(zip(order.tolist(), sizes.tolist())):
            if n:
                path = [int(last[k])]
                for t in range(n - 2, -1, -1):
                    path.append(int(back[t][k, path[-1]]))
                out[i] = path[::-1]
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_field(data: list[tuple[list[Key], list[int]]], steps: int = 120, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximise the conditional likelihood by full-batch Adam on padded sequences; equal sequences are one with a weight."""
    names = {x: i for i, x in enumerate(sorted({x for k in {k for ks, _ in data for k in ks} for x in features(k)}))}
    kinds = Counter((tuple(ks), tuple(ys)) for ks, ys in data)
    n, T, K, D = len(kinds), max(len(y) for _, y in kinds), len(TAGS), len(names)
    X, Y, mask = np.zeros((n, T, D), dtype=np.float32), np.zeros((n, T), dtype=int), np.zeros((n, T), dtype=bool)
    weight = np.array([c * n / len(data) for c in kinds.values()])
    for i, (ks, ys) in enumerate(kinds):
        for t, (k, y) in enumerate(zip(ks, ys)):
            X[i, t, [names[x] for x in features(k)]] = 1
            Y[i, t], mask[i, t] = y, True
    emit, move = np.zeros((D, K)), np.zeros((K, K))
    gold = np.zeros((n, T, K))
    gold[np.arange(n)[:, None], np.arange(T)[None, :], Y] = 1
    gold *= mask[..., None]
    gold_move = np.einsum("n,nta,ntb->ab", weight, gold[:, :-1], gold[:, 1:])
    m1, m2 = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    flat = X.reshape(n * T, D)
    for step in range(1, steps + 1):
        e = (flat @ emit.astype(np.float32)).reshape(n, T, K).astype(float)
        alpha, beta = np.zeros((n, T, K)), np.zeros((n, T, K))
        alpha[:, 0] = e[:, 0]
        for t in range(1, T):
            nxt = _lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            nxt = _lse(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
        z = _lse(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [flat.T @ (weight[:, None, None] * (gold - post)).reshape(n * T, K).astype(np.float32) / n - l2 * emit, (gold_move - np.einsum("n,ntab->ab", weight, pair)) / n - l2 * move]
        for k, (w, g) in enumerate(zip((emit, move), grads)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, emit, move)


def training_sequences(pairs: list[tuple[str, str]], seed: int = 7) -> tuple[list[tuple[list[Key], list[int]]], Wording]:
    """Labelled clause sequences made from pairs that look whole, by planting one defect in each copy, and the model of wordings.

    Sequences of more than WINDOW clauses are trained on in windows.
    """
    rng = np.random.default_rng(seed)
    cut_up = [(q, a, clauses(a)) for q, a in pairs if q and not says_nothing(a)]
    texts = [[masked(c, frozenset(_MARKED.findall(q.casefold()))) for c in parts] for q, _, parts in cut_up]
    wording, folds, fold_of, taken = train_wording([t for own in texts for t in own])
    refused = [any(t in taken for t in own) for own in texts]

    whole = [(q, a, parts) for (q, a, parts), r in zip(cut_up, refused)
             if not r and parts and ending(parts[-1], True) == "stop" and likeness(a, q) < 0.5 and language(q) and language(q) in languages(a[:300])]
    whole = whole or [("How does the cache work?", "The cache keeps the last rows. It drops the oldest first.", ["The cache keeps the last rows.", " It drops the oldest first."])]
    by_lang: dict[str, list[str]] = {}
    for q, a, _ in whole:
        by_lang.setdefault(language(q), []).append(a)
    by_lang.setdefault("de", []).append("Die Karten sind in der Nacht nicht bereit.")
    by_lang.setdefault("fr", []).append("Les cartes ne sont pas dans le dossier.")
    planted: list[tuple[list[tuple[str, str, str, bool]], list[str], list[int]]] = []

    def plant(q: str, a: str, label) -> None:
        parts, feats, own, _ = clause_features(q, a, True)
        if parts:
            planted.append((feats, own, [label(i, len(parts)) for i in range(len(parts))]))

    def spoken(q: str, text: str) -> str:
        words = _WORD.findall(q)
        return text.replace("_", " ".join(words[-int(rng.integers(1, 4)):]) or "it")

    refusals, closings, courtesies, sound = refusal_examples(), labelled(CLOSINGS), labelled(COURTESIES), labelled(SOUND)
    for i, (q, a, parts) in enumerate(whole):
        plant(q, a, lambda i, n: 0)
        plant(q, f"{q}\n{a}", lambda i, n: 2 if i == 0 else 0)
        other = [k for k in by_lang if k != language(q)]
        pool = by_lang[other[rng.integers(len(other))]]
        foreign = pool[rng.integers(len(pool))]
        plant(q, foreign, lambda i, n: 3)
        plant(q, clauses(foreign)[0], lambda i, n: 3)
        echo = [q, f"Q: {q}", f"{q}\n{q.lower()}", q.upper(), q.rstrip("?.")][rng.integers(5)]
        plant(q, echo, lambda i, n: 2)
        for _ in range(4):
            said = spoken(q, refusals[rng.integers(len(refusals))])
            if rng.integers(4) == 0:
                said = spoken(q, courtesies[rng.integers(len(courtesies))]) + "\n" + said
            if rng.integers(2):
                said += "\n" + spoken(q, closings[rng.integers(len(closings))])
            plant(q, said if rng.integers(5) else said.upper(), lambda i, n: 1)
            if i % 8 == 0:
                plant("", said, lambda i, n: 1)
        if i % 8 == 0:
            plant("", a, lambda i, n: 0)
        plant(q, spoken(q, sound[rng.integers(len(sound))]), lambda i, n: 0)
        odd = ODD[i % len(ODD)]
        plant(q, odd, lambda i, n: 0)
        plant(q, f"{a}\n{odd}", lambda i, n: 0)
        cut_off = UNFINISHED[i % len(UNFINISHED)]
        plant(q, f"{a}\n{cut_off}", lambda i, n: 4 if i == n - 1 else 0)
        last = parts[-1]
        if len(last.strip()) > 8:
            end = int(rng.integers(4, len(last.rstrip()) - 3))
            head = a[: a.rfind(last.strip()[:20])]
            plant(q, head + last.strip()[:end].rstrip(".!?。！？। "), lambda i, n: 4 if i == n - 1 else 0)

    unseen = [t for _, own, _ in planted for t in own]
    fold = np.array([fold_of.get(t, k % len(folds)) for k, t in enumerate(unseen)], dtype=int)
    logits = np.zeros(len(unseen))
    for k, model in enumerate(folds):
        where = np.flatnonzero(fold == k)
        logits[where] = model.logits([unseen[w] for w in where])
    data, at = [], 0
    for feats, own, ys in planted:
        full = [with_wording(f, z) for f, z in zip(feats, logits[at : at + len(own)])]
        at += len(own)
        data += [(full[k : k + WINDOW], ys[k : k + WINDOW]) for k in range(0, len(ys), WINDOW)]
    return data, wording


def says_nothing(answer: str | None) -> bool:
    if not answer:
        return True
    if len(answer) > 400:  # no placeholder is as long, unless of marks alone
        return not _LETTER.search(answer)
    t = _TAG.sub("", answer) if "<" in answer or "&" in answer else answer
    return norm(t.replace("```", "")) in PLACEHOLDERS | {""} or answer.strip().lower() in ("n/a", "<empty>", "(blank)")


def verdict(query: str, parts: list[str], letters: list[str], tags: list[int]) -> str | None:
    """The one defect of a pair with a tagged answer, or None for a sound one."""
    if not any(tags):
        return "copies_question" if _likeness("".join(letters), norm(query), 0.8) >= 0.8 else None
    share = [0] * len(TAGS)
    for c, plain, t in zip(parts, letters, tags):
        share[t] += max(1, len(plain) + (0 if c.isascii() else 2 * len(_DENSE.findall(c))))
    share = [x / sum(share) for x in share]
    if share[2] == 1 or _likeness("".join(letters), norm(query), 0.8) >= 0.8:
        return "copies_question"
    if share[1] > 0.5 or tags[0] == 1 and share[1] + share[4] > 0.5:
        return "refusal"
    if share[3] > 0.5:
        return "other_language"
    if tags[-1] == 4:
        return "truncated"
    return "other_language" if share[3] + share[4] > 0.5 and share[3] > share[4] else None


def defects(rows: list[tuple[str | None, str | None, bool]], field: Field, wording: Wording) -> list[str | None]:
    """Defects of (query, answer, whether its end is a known one) rows, all tagged together."""
    out: list[str | None] = ["empty"] * len(rows)
    told = [i for i, (_, a, _) in enumerate(rows) if not says_nothing(a)]
    cut_up = [clause_features(rows[i][0] or "", rows[i][1], rows[i][2]) for i in told]
    logits = wording.logits([t for _, _, texts, _ in cut_up for t in texts]).tolist()
    keys, at = [], 0
    for parts, own, _, _ in cut_up:
        keys.append([with_wording(k, z) for k, z in zip(own, logits[at : at + len(parts)])])
        at += len(parts)
    for i, (parts, _, _, letters), tags in zip(told, cut_up, field.tag(keys)):
        out[i] = verdict(rows[i][0] or "", parts, letters, tags) if parts else "empty"
    return out


def _thai_ends(batches):
    """Last characters of the Thai sentences that others follow in the same answer."""
    for b in batches:
        ends = [p[-4:] for a in b.column(0).to_pylist() for p in a.split()[:-1] if _SCRIPTS[5][0].match(p[-1:])]
        yield pa.RecordBatch.from_pydict({"tail": ends}, schema=pa.schema([("tail", pa.string())]))


def _defects(field: Field, wording: Wording):
    weights, bias = wording.weights.astype(np.float32), wording.bias

    def run(batches):
        for b in batches:
            got = defects(list(zip(*(c.to_pylist() for c in b.columns[1:]))), field, Wording(weights, bias))
            keep = [i for i, d in enumerate(got) if d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i] for i in keep], pa.string())], names=["id", "defect"])
    return run


def pair_defects(pairs: DataFrame, id_col: str = "pair_id", query_col: str = "query", answer_col: str = "answer", sample: int = SAMPLE_PAIRS) -> DataFrame:
    """One row per defective pair: id, defect (empty, truncated, refusal, copies_question or other_language).

    A null answer is empty; a null or empty query has no language and nothing to
    copy, so its answer can only be empty, refusing or truncated; repeated rows
    are judged again; an empty table gives an empty result; other columns are not
    read. The models are trained on about ``sample`` pairs, those whose ids hash lowest
    and whose answers have at most SAMPLE_CHARS characters; every pair is judged whole.
    """
    src = pairs.select(F.col(id_col).alias("id"), F.col(query_col).alias("q"), F.col(answer_col).alias("a"))
    kind = src.schema["id"].dataType.simpleString()
    rows = hashed_sample(src, "id", sample).where(f"a is not null and length(a) <= {SAMPLE_CHARS} and length(q) <= {SAMPLE_CHARS}").orderBy("id").select("q", "a").collect()
    data, wording = training_sequences([(r.q, r.a) for r in rows])
    judge, out = _defects(train_field(data), wording), f"id {kind}, defect string"
    is_thai = F.coalesce(F.col("a").rlike("[\\u0E00-\\u0E7F]"), F.lit(False))
    bare = F.regexp_replace(F.col("a"), "(\\s*\\[\\d+\\])+\\s*$|\\s+$", "")
    thai = src.where(is_thai).withColumn("tail", F.right(bare, F.lit(4)))
    ends = thai.select("a").mapInArrow(_thai_ends, "tail string").distinct().select("tail", F.lit(True).alias("known"))
    judged = spread(src.where(~is_thai).select("id", "q", "a", F.lit(False).alias("known"))).mapInArrow(judge, out)
    ends = cut(ends, "pair-ends")
    if not ends.isEmpty():  # only Thai answers need the ends of other sentences, and only they are joined
        judged = judged.unionByName(thai.join(ends, "tail", "left").select("id", "q", "a", F.coalesce("known", F.lit(False)).alias("known")).mapInArrow(judge, out))
    else:
        judged = judged.unionByName(thai.select("id", "q", "a", F.lit(False).alias("known")).mapInArrow(judge, out))
    return judged.withColumnRenamed("id", id_col)
