"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make scores and offsets.

Labels are of documents, so token labels are derived first: a form (a word, or the first 4 to 6 letters of one) is
telling if many toxic training documents hold it, in many contexts, and next to no clean one does; a token of a toxic document is
labelled if one of its forms is telling. The field has two tags and hashed features of each token and its letters; it
is fitted by gradient ascent on the log-likelihood of stretches of WIDTH tokens: all that hold a labelled token, and up
to CLEAN_STRETCHES of each clean text, spread evenly from its beginning to its end. What else a toxic text holds is left
out, since a token without a label may still be toxic there. A document's score combines the
largest marginal and the expected number of toxic tokens, from the forward and backward passes over all its tokens,
by a logistic curve fitted to the same documents. Offsets of runs of tokens with a marginal of at least a half are
returned as spans.

Passes run over all tokens of a batch at once: texts are cut into stretches whose two-by-two transfer matrices are
multiplied up first, so that long texts take no more rounds than short ones; the result is that of the plain passes.

Defined cases: a null text, an empty one and one without words have the score of a document without tokens; a
training set without both classes scores 0.0; repeated rows score alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import id_and_text, small_batches
from textveil.llm.labelled import class_odds, fold, sample

#: Bounds of the training sample: documents a class, and characters of all of them; each is taken whole or not at all.
TRAIN_PER_CLASS, TRAIN_TOTAL_CHARS = 3000, 12_000_000
#: A form is telling if so many toxic documents hold it, after as many different words, and clean ones at most this much
#: as often. Near copies share a rare word, but with the same word before it. Toxic documents without such a form may
#: name further ones, which need only WEAK_DOCS of them.
TELLING_DOCS, WEAK_DOCS, TELLING_RATIO = 8, 4, 0.02
#: Tokens in a training stretch, of which so many stand before the labelled one; stretches of a clean text at most.
WIDTH, BEFORE, CLEAN_STRETCHES = 32, 12, 6
BUCKETS = 1 << 18
THRESHOLD = 0.3
STRETCH = 128
CACHED_WORDS = 400_000
_TOKEN = re.compile(r"[^\W_]+")


def forms(word: str) -> list[str]:
    """Letters that may tell: the word itself and its beginnings."""
    word = word.lower()
    return ["=" + word] + [f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k]


def features(word: str) -> list[int]:
    lower = word.lower()
    named = [*forms(word), f"${lower[-3:]}", f"#{min(len(lower), 12)}"]
    return [zlib.crc32(x.encode()) % BUCKETS for x in named]


@dataclass
class Crf:
    """weights: of features, for tag 1 against tag 0; joints[a, b]: of tag b after tag a; curve: of the document score."""

    weights: np.ndarray
    joints: np.ndarray
    curve: np.ndarray

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}  # what the driver has looked up isn't sent along

    def emission(self, words: list[str]) -> np.ndarray:
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHED_WORDS:
                known.clear()
            for i, (w, e) in enumerate(zip(words, found, strict=True)):
                if e is None:
                    e = known.get(w)
                    found[i] = known[w] = float(np.clip(self.weights[features(w)].sum(), -15, 15)) if e is None else e
        return np.array(found)


def _forward(emission: np.ndarray, first: np.ndarray, joints: np.ndarray) -> np.ndarray:
    """Log-odds of tag 1 at each token given the tokens so far; first marks the first token of each text.

    emission: (stretches, STRETCH), texts end to end; a text's first token starts anew with equal odds.
    """
    rows, n = emission.shape
    e, t = np.exp(emission), np.exp(joints)
    # transfer matrix of each stretch, as what becomes of odds (1, 0) and (0, 1); a first token forgets both
    zero, one = np.stack([np.ones(rows), np.zeros(rows)]), np.stack([np.zeros(rows), np.ones(rows)])

    def step(state: np.ndarray, k: int) -> np.ndarray:
        a, b = state
        new0, new1 = a * t[0, 0] + b * t[1, 0], (a * t[0, 1] + b * t[1, 1]) * e[:, k]
        begin = first[:, k]
        total = a + b
        new0, new1 = np.where(begin, total, new0), np.where(begin, total * e[:, k], new1)
        return np.stack([new0, new1])

    for k in range(n):
        zero, one = step(zero, k), step(one, k)
        if k % 8 == 7:
            scale = zero.sum(axis=0) + one.sum(axis=0)
            zero, one = zero / scale, one / scale
    start = np.empty((2, rows))
    a, b = 0.5, 0.5
    for r in range(rows):
        start[:, r] = a, b
        a, b = a * zero[0, r] + b * one[0, r], a * zero[1, r] + b * one[1, r]
        total = a + b
        a, b = a / total, b / total
    out = np.empty((rows, n))
    state = start
    for k in range(n):
        state = step(state, k)
        state = state / state.sum(axis=0)
        out[:, k] = state[1]
    return np.log(out + 1e-300) - np.log1p(-np.minimum(out, 1 - 1e-16))


def marginals(emissions: list[np.ndarray], joints: np.ndarray) -> list[np.ndarray]:
    """Probability of tag 1 at each token of each text, by forward and backward passes."""
    lengths = [len(e) for e in emissions]
    n = sum(lengths)
    if not n:
        return [np.zeros(0) for _ in emissions]
    rows = -(-n // STRETCH)

    def laid(values: np.ndarray, fill) -> np.ndarray:
        return np.concatenate([values, np.full(rows * STRETCH - n, fill, values.dtype)]).reshape(rows, STRETCH)

    flat = np.concatenate(emissions)
    begins = np.zeros(n, bool)
    at = np.cumsum([0, *lengths[:-1]])
    begins[at[[k for k, x in enumerate(lengths) if x]]] = True
    ends = np.concatenate([begins[1:], [True]])
    forward = _forward(laid(flat, 0.0), laid(begins, True), joints).ravel()[:n]
    backward = _forward(laid(flat[::-1], 0.0), laid(ends[::-1], True), joints.T).ravel()[:n][::-1]
    p = 1 / (1 + np.exp(-np.clip(forward + backward - flat, -40, 40)))  # both passes count the token's own emission
    return np.split(p, np.cumsum(lengths)[:-1])


def _summary(p: np.ndarray) -> tuple[float, float]:
    if not len(p):
        return -5.0, 0.0
    top = min(max(float(p.max()), 1e-9), 1 - 1e-9)
    return max(-12.0, min(12.0, math.log(top / (1 - top)))), math.log1p(float(p[p > 0.05].sum()))


def train(rows: list[tuple[str, int]], odds: float = 1.0, rounds: int = 25) -> Crf | None:
    """Fit the field to (text, toxic) rows; None without both classes. odds: of a toxic document among all labelled."""
    same: dict[str, str] = {}
    texts = [([same.setdefault(w, w) for w in _TOKEN.findall(t)], y) for t, y in rows]
    sizes = Counter(y for _, y in texts)
    if len(sizes) < 2:
        return None
    clean = Counter()
    for tokens, y in texts:
        if not y:
            clean.update({f for w in set(tokens) for f in forms(w)})
    rate = TELLING_RATIO * sizes[0] / sizes[1]
    toxic = [tokens for tokens, y in texts if y]
    telling = _telling(toxic, clean, rate, min(TELLING_DOCS, max(3, math.ceil(0.05 * sizes[1]))))
    unexplained = [t for t in toxic if not any(f in telling for w in t for f in forms(w))]
    telling |= _telling(unexplained, clean, rate, min(WEAK_DOCS, max(3, math.ceil(0.05 * sizes[1]))))
    tag = lambda w: any(f in telling for f in forms(w))

    # words are numbered, so features are summed once a word
    number: dict[str, int] = {}
    words, tags = [], []
    for tokens, y in texts:
        own = [number.setdefault(w.lower(), len(number)) for w in tokens]
        words.append(np.array(own, np.int32))
        tags.append(y)
    told = np.fromiter((tag(w) for w in number), bool, len(number))
    feature = np.full((len(number) + 1, 6), BUCKETS, np.int64)  # the last word is none
    for w, k in number.items():
        found = features(w)
        feature[k, : len(found)] = found
    cut = [(w[a : a + WIDTH], y) for w, y in zip(words, tags, strict=True) for a in _starts(w, told, y)]
    word, mark = np.full((len(cut), WIDTH), len(number), np.int32), np.zeros((len(cut), WIDTH), np.int64)
    for r, (w, y) in enumerate(cut):
        word[r, : len(w)] = w
        mark[r, : len(w)] = told[w] * y
    mask = word < len(number)
    weights, joints = np.zeros(BUCKETS + 1), np.zeros((2, 2))
    seen, seen_joints = np.full(BUCKETS + 1, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        emission = weights[feature].sum(axis=1)[word] * mask
        p, pairs = _likelihood_gradient(emission, mark, mask, joints)
        of_word = np.bincount(word.ravel(), p.ravel(), len(number) + 1)
        gradient = np.bincount(feature.ravel(), np.repeat(of_word, 6), BUCKETS + 1) - 1e-3 * weights
        gradient[BUCKETS] = 0
        seen += gradient**2
        weights += 0.5 * gradient / np.sqrt(seen)
        seen_joints += pairs**2
        joints += 0.1 * pairs / np.sqrt(seen_joints)
    weights[BUCKETS] = 0
    crf = Crf(weights[:BUCKETS].astype(np.float32), joints, np.zeros(3))
    points, ys = [], []
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        for p, (_, y) in zip(marginals([crf.emission(t) for t, _ in part], crf.joints), part, strict=True):
            points.append((1.0, *_summary(p)))
            ys.append(y)
    x, y = np.array(points), np.array(ys, float)
    curve = np.zeros(3)
    for _ in range(30):  # Newton's method, a little shrunk
        s = 1 / (1 + np.exp(-x @ curve))
        hessian = (x * (s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(3)
        curve += np.linalg.solve(hessian, x.T @ (y - s) - 0.1 * curve)
    curve[0] += math.log(odds * sizes[0] / sizes[1])  # the sample has as many of either class as it can
    crf.curve = curve
    return crf


def _starts(word: np.ndarray, told: np.ndarray, toxic: int) -> list[int]:
    """Where the training stretches of a text begin."""
    if not toxic:
        count = min(CLEAN_STRETCHES, -(-len(word) // WIDTH))
        return [k * max(0, len(word) - WIDTH) // max(1, count - 1) for k in range(count)]
    out, end = [], 0
    for i in np.flatnonzero(told[word]).tolist():
        if i >= end:
            out.append(max(end, i - BEFORE))
            end = out[-1] + WIDTH
    return out


def _telling(toxic: list[list[str]], clean: Counter, rate: float, least: int) -> set[str]:
    """Forms that least of the token lists hold, after least different words, and clean ones at most rate as often."""
    held: Counter = Counter()
    for tokens in toxic:
        held.update({f for w in set(tokens) for f in forms(w)})
    contexts: dict[str, set[str]] = {f: set() for f, n in held.items() if n >= least and clean[f] <= rate * n}
    for tokens in toxic:
        for before, w in zip(["", *tokens], tokens, strict=False):
            for f in forms(w):
                if f in contexts:
                    contexts[f].add(before)
    return {f for f, c in contexts.items() if len(c) >= least}


def _likelihood_gradient(emission: np.ndarray, tags: np.ndarray, mask: np.ndarray, joints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected tags, and tag pairs, of padded stretches."""
    n, width = emission.shape
    t = np.exp(joints)
    e = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2)
    alpha, beta = np.zeros((n, width, 2)), np.ones((n, width, 2))
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, width):
        a = (alpha[:, k - 1] @ t) * e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], a / a.sum(axis=1, keepdims=True), alpha[:, k - 1])
    for k in range(width - 2, -1, -1):
        b = (beta[:, k + 1] * e[:, k + 1]) @ t.T
        beta[:, k] = np.where(mask[:, k + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((2, 2))
    for k in range(1, width):
        both = alpha[:, k - 1, :, None] * t * (e[:, k] * beta[:, k])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        live = mask[:, k]
        pairs -= both[live].sum(axis=0)
        np.add.at(pairs, (tags[live, k - 1], tags[live, k]), 1)
    return (tags - gamma[:, :, 1]) * mask, pairs


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of a half or more, as character offsets."""
    if not len(p) or p.max() < 0.5:
        return []
    out: list[dict] = []
    last = -2
    for i, (m, x) in enumerate(zip(_TOKEN.finditer(text), p.tolist(), strict=True)):
        if x >= 0.5:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], x)}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": x})
            last = i
    return out


def score_documents(docs: DataFrame, crf: Crf | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, spans for each row of docs."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if crf is None:
                scores, spans = [0.0] * len(texts), [[] for _ in texts]
            else:
                found = marginals([crf.emission(_TOKEN.findall(t)) for t in texts], crf.joints)
                points = np.array([(1.0, *_summary(p)) for p in found]).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-points @ crf.curve))
                spans = [spans_of(t, p) for t, p in zip(texts, found, strict=True)]
            predicted = [int(s >= threshold) for s in scores]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "spans"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def keep_clean(docs: DataFrame, crf: Crf | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns as they were."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            if crf and texts:
                found = marginals([crf.emission(_TOKEN.findall(t)) for t in texts], crf.joints)
                scores = 1 / (1 + np.exp(-np.array([(1.0, *_summary(p)) for p in found]) @ crf.curve))
                batch = batch.filter(pa.array(scores < threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Crf | None:
    rows = sample(docs, labels, label, usable, TRAIN_PER_CLASS, TRAIN_TOTAL_CHARS)
    return train(rows, class_odds(labels, label, usable))


def learnable() -> Column:
    """The rows whose labels may be learnt from."""
    return fold("doc_id", 4) != 2
