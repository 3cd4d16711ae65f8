"""Quality: a byte-level convolutional network in numpy.

Filters of four bytes, learnt as a table of weights for each byte and offset, run over every byte of a text. One more
input channel marks bytes whose eight-byte string recurs within the next 40 bytes, which no fixed filter could see.
Responses are averaged over overlapping chunks of 64 bytes (a new chunk each 32), a learnt layer combines them within
the chunk, the maximum over all chunks of the document is pooled, and a last layer makes one probability. Long texts
run a segment at a time: the maximum over segments is that over the text.

Training takes a bounded sample of whole texts (TRAIN_PER_CLASS documents a class, TRAIN_TOTAL_CHARS characters of all
of them, each whole or not at all); the offset of the score is then set for the share of the classes among all labels that may be learnt from.

Defined cases: a null or empty text is scored as one chunk of zero bytes; a training set without both classes scores
0.5; repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from textveil.llm.common import id_and_text, small_batches
from textveil.llm.labelled import class_odds, fold, sample

TRAIN_PER_CLASS, TRAIN_TOTAL_CHARS = 1500, 16_000_000
THRESHOLD = 0.3
REACH, HALF, FILTERS, UNITS, LAGS = 4, 32, 16, 12, 40
SEGMENT = 1 << 17


@dataclass
class Net:
    """table: (REACH, 256, FILTERS); recur, bias: (FILTERS,); mix: (FILTERS, UNITS); mix_bias, out: (UNITS,); offset."""

    table: np.ndarray
    recur: np.ndarray
    bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    def responses(self, data: np.ndarray, recurs: np.ndarray) -> np.ndarray:
        """Filters at each byte; data has REACH - 1 bytes more than recurs."""
        n = len(recurs)
        total = self.table[0][data[:n]]
        for k in range(1, REACH):
            total += self.table[k][data[k : k + n]]
        total[recurs] += self.recur
        total += self.bias
        return np.maximum(total, 0, out=total)

    def chunks(self, data: np.ndarray, recurs: np.ndarray) -> np.ndarray:
        """Mean responses of each chunk; recurs holds a whole number of half chunks, two or more."""
        halves = self.responses(data, recurs).reshape(-1, HALF, FILTERS).sum(axis=1)
        return (halves[:-1] + halves[1:]) * np.float32(1 / (2 * HALF))

    def pooled(self, raw: bytes) -> np.ndarray:
        best = np.full(UNITS, -np.inf, np.float32)
        for data, recurs in segments(raw):
            best = np.maximum(best, (self.chunks(data, recurs) @ self.mix + self.mix_bias).max(axis=0))
        return np.maximum(best, 0)

    def score(self, raw: bytes) -> float:
        x = float(self.pooled(raw) @ self.out + self.offset[0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def recurring(data: np.ndarray) -> np.ndarray:
    """Bytes that start an eight-byte string found again within LAGS bytes."""
    found = np.zeros(len(data), bool)
    if len(data) <= 8:
        return found
    grams = np.lib.stride_tricks.sliding_window_view(data, 8)
    grams = np.ascontiguousarray(grams).view(np.uint64).ravel()
    for lag in range(1, min(LAGS, len(grams) - 1) + 1):
        found[: len(grams) - lag] |= grams[:-lag] == grams[lag:]
    return found


def segments(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text in parts that overlap by half a chunk, the last padded with zero bytes."""
    for a in range(0, max(1, len(raw) - HALF), SEGMENT):
        part = np.frombuffer(raw[a : a + SEGMENT + HALF + LAGS + 8], np.uint8)
        own = min(len(raw) - a, SEGMENT + HALF)
        n = max(2, -(-own // HALF)) * HALF
        recurs = np.zeros(n, bool)
        recurs[:own] = recurring(part)[:own]
        data = np.zeros(n + REACH - 1, np.uint8)
        data[: min(own + REACH - 1, len(part))] = part[: own + REACH - 1]
        yield data, recurs


def train(rows: list[tuple[str, int]], odds: float = 1.0, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net | None:
    """Fit the network to (text, quality) rows by Adam; None without both classes."""
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return None
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(
        rng.normal(0, 0.2, (REACH, 256, FILTERS)).astype(f32), np.full(FILTERS, 0.1, f32) * rng.choice([-1, 1], FILTERS).astype(f32), np.zeros(FILTERS, f32),
        rng.normal(0, 0.5, (FILTERS, UNITS)).astype(f32), np.zeros(UNITS, f32), rng.normal(0, 0.5, UNITS).astype(f32), np.zeros(1, f32),
    )
    inputs = [list(segments(t.encode())) for t, _ in rows]
    names = list(Net.__dataclass_fields__)
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            grad = {k: np.zeros_like(getattr(net, k)) for k in names}
            parts, marks, back = [], [], []
            for i in order[at : at + batch]:
                held = [net.chunks(data, recurs) for data, recurs in inputs[i]]
                chunks = held[0] if len(held) == 1 else np.concatenate(held)
                units = chunks @ net.mix + net.mix_bias
                top = units.argmax(axis=0)
                value = np.maximum(units[top, np.arange(UNITS)], 0)
                first_chunk = np.cumsum([0, *(len(h) for h in held)])
                p = 1 / (1 + np.exp(-np.clip(value @ net.out + net.offset[0], -30, 30)))
                error = f32((rows[i][1] - p) / batch)
                grad["out"] += error * value
                grad["offset"] += error
                live = error * net.out * (value > 0)
                grad["mix_bias"] += live
                grad["mix"] += chunks[top].T * live
                for u in np.flatnonzero(live):
                    part = int(np.searchsorted(first_chunk, top[u], "right")) - 1
                    data, recurs = inputs[i][part]
                    a = int(top[u] - first_chunk[part]) * HALF
                    parts.append(data[a : a + 2 * HALF + REACH - 1])
                    marks.append(recurs[a : a + 2 * HALF])
                    back.append(live[u] * net.mix[:, u])
            if parts:
                data, recurs = np.stack(parts), np.stack(marks)
                n = 2 * HALF
                total = sum(net.table[k][data[:, k : k + n]] for k in range(REACH)) + net.bias + recurs[:, :, None] * net.recur
                pull = (np.stack(back)[:, None, :] * (total > 0) / f32(n)).astype(f32)
                grad["bias"] += pull.sum(axis=(0, 1))
                grad["recur"] += pull[recurs].sum(axis=0)
                flat = pull.reshape(-1, FILTERS)
                for k in range(REACH):
                    keys = data[:, k : k + n].ravel()
                    by = np.argsort(keys, kind="stable")
                    found, starts = np.unique(keys[by], return_index=True)
                    grad["table"][k][found] += np.add.reduceat(flat[by], starts, axis=0)
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) + move).astype(f32))
    net.offset = net.offset + f32(math.log(odds * (len(rows) - ones) / ones))
    return net


def score_documents(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(bytes(memoryview(t.as_buffer()))) if net else 0.5 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Net | None:
    return train(sample(docs, labels, label, usable, TRAIN_PER_CLASS, TRAIN_TOTAL_CHARS), class_odds(labels, label, usable))


def learnable() -> Column:
    """The rows whose labels may be learnt from."""
    return fold("doc_id", 5) != 0
