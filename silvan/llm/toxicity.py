"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field has two tags, clean and toxic. A token's word (if it is one of the lexicon's) or the default weight scores
the toxic tag; four weights score tag pairs. Runs of default tokens are powers of one 2 x 2 matrix, so forward-backward
over a document takes work in proportion to its lexicon words, whatever its length, and is still exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_fold, texts_of

#: Labelled documents that the field is fitted on, at most.
SAMPLE = 8000
#: Words of the lexicon (and as many beginnings), and windows of the fit that are drawn evenly, at most; half of these with marked words.
LEXICON, SENTENCES = 2000, 12_000
#: Words of a window; longer sentences are cut into several. Windows that each marked word is in at least, as far as there are as many.
WINDOW, EACH = 64, 5
FOLDS, HELD = 5, 0
SPAN = 0.5
#: First bytes that stand for a word that is not in the lexicon itself.
HEAD = 4
#: Letters, digits and all bytes beyond ASCII make words; A-Z count as a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STOPS = re.compile(rb"[.!?\n]+")
_RUNS = re.compile(rb"[^ ]+")


@dataclass
class Field:
    """word: weight of the toxic tag for lexicon words; head: for other words, by their first HEAD bytes; other: for the rest; pair[a][b]: weight of tag b behind a;
    start: of the toxic tag at the first token; link: weights that turn a document's marginals into its score."""

    word: dict[bytes, float] = field(default_factory=dict)
    head: dict[bytes, float] = field(default_factory=dict)
    other: float = -4.0
    pair: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: float = 0.0
    link: tuple[float, float] = (-3.0, 0.0)

    def __post_init__(self) -> None:
        step = np.exp(np.array(self.pair)) * np.array([1.0, math.exp(self.other)])
        self.values, self.vectors = np.linalg.eig(step)
        order = np.argsort(-self.values.real)
        self.values, self.vectors = self.values.real[order], self.vectors.real[:, order]
        self.inverse = np.linalg.inv(self.vectors)

    def run(self, n: int) -> np.ndarray:
        """The matrix of n default tokens in a row, up to a factor."""
        return (self.vectors * (self.values / self.values[0]) ** n) @ self.inverse

    def marginals(self, at: list[int], scores: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens at positions `at`, with those toxic weights, in a document of n tokens."""
        if not at:
            return []
        pair = np.exp(np.array(self.pair))
        first = np.array([1.0, math.exp(self.start)])
        forward, before, vector = [], -1, None
        for i, s in zip(at, scores, strict=True):
            here = np.array([1.0, math.exp(min(s, 30.0))])
            if vector is None:
                vector = first * here if i == 0 else (first * np.array([1.0, math.exp(self.other)])) @ self.run(i - 1) @ pair * here
            else:
                vector = vector @ self.run(i - before - 1) @ pair * here
            vector = vector / vector.sum()
            forward.append(vector)
            before = i
        out, back, later, there = [], np.ones(2), n, None
        for i, s, f in zip(reversed(at), reversed(scores), reversed(forward), strict=True):
            if there is None:
                back = self.run(n - 1 - i) @ np.ones(2)
            else:
                back = self.run(later - i - 1) @ (pair @ (there * back))
            back = back / back.sum()
            both = f * back
            out.append(float(both[1] / both.sum()))
            there, later = np.array([1.0, math.exp(min(s, 30.0))]), i
        return out[::-1]

    def events(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Positions of the words that aren't default tokens, and their P(toxic)."""
        word, head = self.word, self.head
        at = [i for i, w in enumerate(words) if w in word or w[:HEAD] in head]
        weights = [word[w] if (w := words[i]) in word else head[w[:HEAD]] for i in at]
        return at, self.marginals(at, weights, len(words))

    def tag(self, text: bytes) -> tuple[float, list[tuple[int, int]]]:
        """(score, spans of toxic words in code points) of a text."""
        plain = text.translate(_WORDS)
        at, p = self.events(plain.split())
        if not at:
            return self.score([]), []
        toxic = {i for i, x in zip(at, p, strict=True) if x >= SPAN}
        places = [m.span() for i, m in enumerate(_RUNS.finditer(plain)) if i in toxic] if toxic else []
        spans, done, chars = [], 0, 0
        for start, end in places:
            chars += len(text[done:start].decode())
            spans.append((chars, chars + len(text[start:end].decode())))
            chars, done = spans[-1][1], end
        return self.score(p), spans

    def score(self, p: list[float]) -> float:
        """Noisy-or of the marginals, brought to the labels' scale."""
        clean = math.prod(1 - x for x in p)
        return 1 / (1 + math.exp(-(self.link[0] + self.link[1] * (1 - clean))))


def fit(rows: list[tuple[bytes, int]]) -> Field:
    """The field of labelled documents (text, toxic 0 or 1); without documents of both labels, one that scores them all alike.

    A word is labelled toxic where it stands in a toxic document and is one, or begins like one, that clean documents
    hardly ever have; it must do so between different neighbours, since what surrounds a toxic word in copies of one
    passage comes with it. The field is fitted on windows of whole sentences (WINDOW words at most) that are drawn evenly
    over all rows, SENTENCES / 2 with marked words of toxic documents and as many others, and on further ones for marked
    words that fewer than EACH of them hold.
    """
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return Field(link=(4.0 if n_toxic else -4.0, 0.0))
    bad = _telling(rows, lambda w: w)
    heads = _telling(rows, lambda w: w[:HEAD])
    marks = lambda words: {(w in bad, w if w in bad else w[:HEAD]) for w in words if w in bad or w[:HEAD] in heads}
    # words are split anew in each pass: held all at once they would take many times the texts' memory
    totals, most = Counter(bool(y and marks(words)) for words, y in _windows(rows)), SENTENCES // 2
    seen, held, chosen = Counter(), Counter(), []
    for words, y in _windows(rows):
        own = marks(words) if y else set()
        loud, total = bool(own), totals[bool(own)]
        i = seen[loud]
        seen[loud] += 1
        if total <= most or (i + 1) * most // total > i * most // total or any(held[w] < EACH for w in own):
            chosen.append((words, y))
            held.update(own)
    found = _ascend(chosen, sorted(bad), sorted(heads))
    inputs = [1 - math.prod(1 - x for x in found.events(text.translate(_WORDS).split())[1]) for text, _ in rows]
    found.link = _logistic(np.array(inputs), np.array([y for _, y in rows], float))
    return found


def _windows(rows: list[tuple[bytes, int]]) -> Iterator[tuple[list[bytes], int]]:
    """Sentences with their labels, in windows of at most WINDOW words that follow each other."""
    for words, y in _sentences(rows):
        for i in range(0, len(words), WINDOW):
            yield words[i : i + WINDOW], y


def _sentences(rows: list[tuple[bytes, int]]) -> Iterator[tuple[list[bytes], int]]:
    for text, y in rows:
        for part in _STOPS.split(text):
            words = part.translate(_WORDS).split()
            if words:
                yield words, y


def _telling(rows: list[tuple[bytes, int]], form: Callable[[bytes], bytes]) -> set[bytes]:
    """The words, in the form asked for, that toxic documents have and clean ones hardly ever, too often for chance: one that
    has nothing to do with toxicity meets toxic documents alone with probability rate ** count, and there are many words."""
    toxic, clean = Counter(), Counter()
    for text, y in rows:
        (toxic if y else clean).update(set(map(form, text.translate(_WORDS).split())))
    many = sum(1 for n in toxic.values() if n >= 3)
    rate = sum(y for _, y in rows) / len(rows)
    least = max(3, math.ceil(math.log(20 * max(1, many)) / -math.log(rate)))
    likely = {w for w, n in toxic.items() if n >= least and clean[w] <= n / 20}
    around: dict[bytes, set[int]] = {w: set() for w in likely}
    for text, y in rows:
        if y:
            words = list(map(form, text.translate(_WORDS).split()))
            for before, w, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
                if w in likely:
                    around[w].add(hash((before, after)))
    return set(sorted((w for w in likely if len(around[w]) >= least), key=lambda w: (-toxic[w], w))[:LEXICON])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a small ridge."""
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta = beta + np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1])


def _ascend(labelled: list[tuple[list[bytes], int]], lexicon: list[bytes], heads: list[bytes], steps: int = 60) -> Field:
    """Weights that maximise the conditional likelihood of the labelled tokens, by adaptive gradient steps. Marked words are
    toxic tokens in windows of toxic documents; in clean ones they are clean tokens, which lowers their weights.

    Forward-backward runs over all sentences at once, a column of tokens at a time.
    """
    index, index_head = {w: i + 1 for i, w in enumerate(lexicon)}, {h: i + 1 + len(lexicon) for i, h in enumerate(heads)}
    labelled = sorted(labelled, key=lambda s: -len(s[0]))
    sentences, toxic = [words for words, _ in labelled], np.array([y for _, y in labelled], bool)
    n, width = len(sentences), len(sentences[0]) if sentences else 1
    feature, lengths = np.zeros((n, width), np.int64), np.array([len(s) for s in sentences])
    for i, words in enumerate(sentences):
        feature[i, : len(words)] = [index.get(w) or index_head.get(w[:HEAD], 0) for w in words]
    live = np.arange(width) < lengths[:, None]
    gold = (feature > 0) & live & toxic[:, None]
    weight, pair, start = np.zeros(len(lexicon) + len(heads) + 1), np.zeros((2, 2)), np.zeros(1)
    sums = [np.full_like(weight, 1e-2), np.full_like(pair, 1e-2), np.full_like(start, 1e-2)]
    columns = [int(live[:, t].sum()) for t in range(width)]
    for _ in range(steps):
        score, factor = np.exp(np.clip(weight[feature], -30, 30)), np.exp(pair)
        first = np.stack([np.ones(n), np.exp(start[0]) * score[:, 0]], 1)
        forward = [first / first.sum(1, keepdims=True)]
        for t in range(1, width):
            m = columns[t]
            step = forward[-1][:m] @ factor
            step[:, 1] *= score[:m, t]
            forward.append(step / step.sum(1, keepdims=True))
        tags, pairs, back = np.zeros((n, width)), np.zeros((2, 2)), np.ones((columns[-1], 2))
        for t in range(width - 1, -1, -1):
            if len(back) < columns[t]:
                back = np.concatenate([back, np.ones((columns[t] - len(back), 2))])
            both = forward[t] * back
            tags[: columns[t], t] = both[:, 1] / both.sum(1)
            if t:
                m = columns[t]
                ahead = back.copy()
                ahead[:, 1] *= score[:m, t]
                joint = forward[t - 1][:m, :, None] * factor * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                back = ahead @ factor.T
                back /= back.sum(1, keepdims=True)
        gap = np.where(live, gold - tags, 0.0)
        seen = np.zeros((2, 2))
        g, nxt = gold[:, :-1].astype(int), gold[:, 1:].astype(int)
        np.add.at(seen, (g[live[:, 1:]], nxt[live[:, 1:]]), 1)
        grads = [np.bincount(feature.ravel(), gap.ravel(), len(weight)) - 0.02 * weight, seen - pairs - 0.02 * pair, np.array([gap[:, 0].sum()]) - 0.02 * start]
        for value, grad, total in zip((weight, pair, start), grads, sums, strict=True):
            total += grad * grad
            value += 1.5 * grad / np.sqrt(total)
    learned = weight[1:].tolist()
    return Field(dict(zip(lexicon, learned[: len(lexicon)], strict=True)), dict(zip(heads, learned[len(lexicon) :], strict=True)), float(weight[0]), tuple(map(tuple, pair.tolist())), float(start[0]))


def scored(docs: DataFrame, model: Field) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted, spans "start:end,..." in code points.

    A null text counts as empty; an empty text has the score of one without toxic words. Rows are independent. No shuffle.
    """

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [model.tag(text) for text in texts_of(batch.column(1))]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([text_fold(i, FOLDS) == HELD for i in ids], pa.bool_()), pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([",".join(f"{a}:{b}" for a, b in spans) for _, spans in found], pa.string()),
            ], ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tag, "doc_id long, held_out boolean, score double, predicted int, spans string")


def without_toxic(docs: DataFrame, model: Field) -> DataFrame:
    """The rows of docs, with all their columns, that the field does not reject. No shuffle."""
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.tag(t)[0] < 0.5 for t in texts_of(batch.column(text))], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
