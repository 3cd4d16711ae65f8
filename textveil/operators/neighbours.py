"""The nearest of all vectors, in blocks: every pair is compared, a block of queries at a time with a block of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block; two blocks and their product bound a worker's memory.
BLOCK = 2048


class Best:
    """The `most` best words of each query of a block, over the blocks of words seen so far; of equals the least word."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int):
        self.ids, self.vectors, self.most = ids, vectors, most
        self.row, self.score, self.word = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)  # a row's last place, once it has all places

    def add(self, words: np.ndarray, vectors: np.ndarray) -> None:
        cosine = self.vectors @ vectors.T
        least = self.least
        if len(words) >= self.most and np.isneginf(least).any():
            least = np.maximum(least, np.partition(cosine, len(words) - self.most, axis=1)[:, len(words) - self.most])
        # 1e-9: what rounding may make equal is not left out
        rows, columns = np.nonzero(cosine >= least[:, None] - 1e-9)
        score = np.clip((np.round(cosine[rows, columns], 9) + 1) / 2, 0.0, 1.0)
        row, score, word = np.concatenate([self.row, rows]), np.concatenate([self.score, score]), np.concatenate([self.word, words[columns]])
        order = np.lexsort((word, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        held = order[place < self.most]
        self.least[row[place == self.most - 1]] = 2 * score[order[place == self.most - 1]] - 1
        self.row, self.score, self.word = row[place < self.most], score[held], word[held]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.word), pa.array(self.score)], names=["vec_id", "word", "score"])


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """ids, unit: up to size vectors of vectors (vec_id, v: array<double>), scaled to length one, as bytes."""

    def block(ids: list, rows: list) -> pa.RecordBatch:
        unit = np.array(rows, np.float64)
        norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([unit.tobytes()])], names=["ids", "unit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield block(ids, rows)

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, unit binary")


def nearest(vectors: DataFrame, most: int = 8, size: int = BLOCK) -> DataFrame:
    """vec_id, word, score: for each of vectors (vec_id long, v array<double>) the most best of all, itself among them, by
    (cosine + 1) / 2 of the cosine rounded to nine digits; of equals the least word.

    Defined cases: a vector of zeros has cosine 0 with all; fewer than most vectors give all; an empty table gives no
    rows. Null vectors are left out; all others must have one length.
    """
    from pyspark.sql import Window

    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # rows are blocks
    made = blocks(vectors.where("v is not null"), size).persist()
    made.count()
    pairs = made.crossJoin(made.selectExpr("ids as words", "unit as word_unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = None, None
        for batch in batches:
            for ids, unit, words, word_unit in zip(*(batch.column(c) for c in range(4)), strict=True):
                raw, words = ids.as_py(), np.frombuffer(words.as_buffer(), np.int64)
                if raw != own:
                    if best:
                        yield best.rows()
                    own, q = raw, np.frombuffer(raw, np.int64)
                    best = Best(q, np.frombuffer(unit.as_py(), np.float64).reshape(len(q), -1), most)
                best.add(words, np.frombuffer(word_unit.as_buffer(), np.float64).reshape(len(words), -1))
        if best:
            yield best.rows()

    found = pairs.mapInArrow(run, "vec_id long, word long, score double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "word"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("vec_id", "word", "score")
