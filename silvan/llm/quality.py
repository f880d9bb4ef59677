"""Document quality by a convolutional network over bytes, in numpy.

A document is read in overlapping chunks, so that every window of bytes lies in one of them. Learned filters answer at
each byte; each filter's greatest answer over the whole document goes, squashed, into one logistic output. Bytes that
go on repeating what stood a few bytes before are read as one extra symbol, which no byte of UTF-8 uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_fold, texts_of

#: Labelled documents that the network is fitted on, at most.
SAMPLE = 3000
FOLDS, HELD = 4, 2
KEEP = 0.7
FILTERS, WIDTH, EPOCHS, BATCH, RATE = 12, 6, 8, 64, 0.02
#: Bytes of a chunk; its overlap with the next is what a filter and a repetition reach over.
CHUNK = 1 << 16
PERIODS, RUN, REPEATED = range(2, 25), 24, 255
OVERLAP = WIDTH - 1 + max(PERIODS) + RUN


def symbols(chunk: np.ndarray) -> np.ndarray:
    """The chunk's bytes, with REPEATED where the last RUN bytes equal those a period before."""
    marked = np.zeros(len(chunk), bool)
    for period in PERIODS:
        same = chunk[period:] == chunk[:-period]
        if len(same) < RUN:
            break
        long, have = same, 1
        while have < RUN:
            shift = min(have, RUN - have)
            long = long[shift:] & long[:-shift]
            have += shift
        marked[period + RUN - 1 :] |= long
    out = chunk.copy()
    out[marked] = REPEATED
    return out


def chunks(data: bytes) -> Iterator[np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP):
        yield symbols(raw[at : at + CHUNK])


def _pairs(x: np.ndarray) -> np.ndarray:
    return x[:-1].astype(np.int32) << 8 | x[1:]


@dataclass
class Network:
    """filters[j, byte, k]: answer of filter k to the byte at place j of its window; out: weights of the squashed answers; bias."""

    filters: np.ndarray
    out: np.ndarray
    bias: float

    def tables(self) -> list[np.ndarray]:
        """Answers to pairs of neighbouring bytes, one table for each second place."""
        f = self.filters
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]

    @staticmethod
    def answers(x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray | None:
        """[position, filter]; None if the chunk is shorter than a window."""
        n = len(x) - WIDTH + 1
        if n < 1:
            return None
        pairs = _pairs(x)
        total = tables[0][pairs[:n]]
        for i in range(1, len(tables)):
            total += tables[i][pairs[2 * i : 2 * i + n]]
        return total

    def peaks(self, data: bytes, tables: list[np.ndarray]) -> np.ndarray:
        best = np.zeros(self.filters.shape[2], np.float32)
        for x in chunks(data):
            got = self.answers(x, tables)
            if got is not None:
                np.maximum(best, got.max(0), out=best)
        return best

    def probability(self, data: bytes, tables: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-(np.tanh(self.peaks(data, tables)) @ self.out + self.bias))))


def fit(rows: list[tuple[bytes, int]]) -> Network:
    """The network of labelled documents (text, quality 0 or 1), by Adam steps on the log loss.

    A filter learns from the window that it answers most to in each document, over the chunks that scoring sees. Without rows of both labels the network
    scores all documents alike.
    """
    draw = np.random.default_rng(7)
    net = Network(draw.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), draw.normal(0, 0.3, FILTERS), 0.0)
    y_all = np.array([y for _, y in rows], float)
    if not len(rows) or y_all.min() == y_all.max():
        net.out[:] = 0
        net.bias = 0.0 if not len(rows) else 3.0 if y_all[0] else -3.0
        return net
    rate = np.clip(y_all.mean(), 0.02, 0.98)
    net.bias = float(np.log(rate / (1 - rate)))
    data = [list(chunks(text)) for text, _ in rows]
    state = {name: [np.zeros_like(value, np.float64), np.zeros_like(value, np.float64)] for name, value in (("filters", net.filters), ("out", net.out), ("bias", np.zeros(1)))}
    step = 0
    for _ in range(EPOCHS):
        for batch in np.array_split(draw.permutation(len(rows)), max(1, -(-len(rows) // BATCH))):
            tables = net.tables()
            peaks, windows = np.zeros((len(batch), FILTERS)), np.zeros((len(batch), FILTERS, WIDTH), np.int64)
            for i, r in enumerate(batch.tolist()):
                for chunk in data[r]:
                    got = net.answers(chunk, tables)
                    if got is not None:
                        place = got.argmax(0)
                        top = got[place, np.arange(FILTERS)]
                        more = np.flatnonzero(top > peaks[i])
                        peaks[i, more] = top[more]
                        windows[i, more] = chunk[place[more, None] + np.arange(WIDTH)]
            squashed = np.tanh(peaks)
            p = 1 / (1 + np.exp(-(squashed @ net.out + net.bias)))
            error = (p - y_all[batch]) / len(batch)
            back = error[:, None] * net.out * (1 - squashed**2) * (peaks > 0)
            grad = np.zeros(net.filters.shape)
            for j in range(WIDTH):
                np.add.at(grad[j], (windows[:, :, j], np.broadcast_to(np.arange(FILTERS), peaks.shape)), back)
            step += 1
            for name, g in (("filters", grad), ("out", squashed.T @ error + 1e-4 * net.out), ("bias", np.array([error.sum()]))):
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                if name == "filters":
                    net.filters -= move.astype(np.float32)
                elif name == "out":
                    net.out -= move
                else:
                    net.bias -= float(move[0])
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null text counts as empty; an empty text, or one shorter than a filter, answers no filter and has the score of the
    bias. Rows are independent. No shuffle.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            p = [net.probability(text, tables) for text in texts_of(batch.column(1))]
            held = [text_fold(i, FOLDS) == HELD for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= KEEP) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
