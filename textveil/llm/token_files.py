"""Token-id output: Arrow stream files of fixed-size-list batches, read back without copying.

A shard holds the ids of consecutive documents, end to end, cut into sequences of equal length; only its last
sequence is padded, and a mask (a bit each) marks real ids. Every record batch but the last has the same number of sequences and
so the same number of bytes, which makes any sequence's place in the file a product. Beside each shard lies a small
stream file with a row (doc_id, start, n_tokens) for each document.

Documents are range-partitioned by doc_id (rows that share one are spread by their text), sorted and encoded where
they land; a task writes its shard under a name of its own attempt and then renames it, so a retried task replaces
its shard as a whole. Only one row a shard, its number of ids, goes to the driver.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; repeated doc_ids keep a row
each, ordered by text; an empty table gives no shard and no row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm.chunk_bpe import largest_id, worker_encoder
from textveil.llm.common import id_and_text, new_path, small_batches

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class Layout:
    """sequence_length ids (a multiple of 8) a sequence, batch_sequences sequences a record batch, ids of 16 or 32 bits.

    write_token_files() takes 32 bits unless all of the vocabulary's ids fit into 16.
    """

    sequence_length: int = 2048
    batch_sequences: int = 64
    wide: bool = False

    def __post_init__(self):
        if self.sequence_length % 8:
            raise ValueError("a sequence's mask is a whole number of bytes, so its length must be a multiple of 8")

    @property
    def schema(self) -> pa.Schema:
        kind = pa.uint32() if self.wide else pa.uint16()
        return pa.schema([("ids", pa.list_(kind, self.sequence_length)), ("mask", pa.list_(pa.bool_(), self.sequence_length))])

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        """ids: at most batch_sequences * sequence_length of them; the rest of the last sequence is padding."""
        if not self.wide and len(ids) and ids.max() > 0xFFFF:
            raise ValueError(f"id {ids.max()} doesn't fit into 16 bits")
        n = -(-len(ids) // self.sequence_length) * self.sequence_length
        flat = np.zeros(n, np.uint32 if self.wide else np.uint16)
        flat[: len(ids)] = ids
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence_length) for x in (flat, np.arange(n) < len(ids))]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Appends documents' ids to a shard, a full record batch at a time."""

    def __init__(self, folder: str, part: int, attempt: str, layout: Layout):
        self.store, root = _store(folder)
        self.layout, self.final, self.own = layout, f"{root}/shard-{part:06d}", f"{root}/.{attempt}-{part:06d}"
        self.file = self.store.open_output_stream(f"{self.own}.ids")
        self.stream = pa.ipc.new_stream(self.file, layout.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        full = self.layout.batch_sequences * self.layout.sequence_length
        if self.n_held >= full:
            ids = np.concatenate(self.held)
            for k in range(0, self.n_held - self.n_held % full, full):
                self.stream.write_batch(self.layout.batch(ids[k : k + full]))
            self.held = [ids[self.n_held - self.n_held % full :].copy()]
            self.n_held %= full

    def close(self) -> None:
        if self.n_held:
            self.stream.write_batch(self.layout.batch(np.concatenate(self.held)))
        self.stream.close()
        self.file.close()
        with self.store.open_output_stream(f"{self.own}.docs") as out, pa.ipc.new_stream(out, DOCS) as rows:
            columns = list(zip(*self.docs, strict=True)) or [[], [], []]
            rows.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=DOCS))
        for kind in ("ids", "docs"):
            self.store.move(f"{self.own}.{kind}", f"{self.final}.{kind}")


class Shard:
    """Random access to a shard on a local or mounted path; the arrays are views of the mapped file."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        reader = pa.ipc.open_stream(self.map)
        self.schema, self.length = reader.schema, reader.schema.field("ids").type.list_size
        self.first = self.map.tell()
        try:
            self.sequences = reader.read_next_batch().num_rows  # of every batch but the last
            self.step = self.map.tell() - self.first
        except StopIteration:
            self.sequences, self.step = 1, 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence i, and its mask as packed bits, the lowest bit first (see unpacked); both views, not copies."""
        k, row = divmod(i, self.sequences)
        if not self.step or i < 0 or self.first + k * self.step >= self.map.size():
            raise IndexError(i)
        self.map.seek(self.first + k * self.step)
        message = pa.ipc.read_message(self.map)
        if message is None:
            raise IndexError(i)
        batch = pa.ipc.read_record_batch(message, self.schema)
        if row >= batch.num_rows:
            raise IndexError(i)
        at, n = row * self.length, self.length
        ids, mask = (batch.column(c).values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True)[at : at + n], np.frombuffer(mask.buffers()[1], np.uint8)[at // 8 : (at + n) // 8]

    @staticmethod
    def unpacked(mask: np.ndarray) -> np.ndarray:
        """A mask's bits as booleans: a copy."""
        return np.unpackbits(mask, bitorder="little").astype(bool)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, layout: Layout = Layout(), leading_space: bool = True) -> list[tuple[int, int]]:
    """Write docs (doc_id, text) into folder in ascending doc_id order; a (shard, ids before it) for each shard."""
    small_batches(docs.sparkSession)
    layout = replace(layout, wide=layout.wide or max(end_id, largest_id(tokenizer_path)) > 0xFFFF)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = id_and_text(docs).withColumn("spread", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, shard = TaskContext.get(), worker_encoder(tokenizer_path, leading_space), None
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard is None:
                    shard = ShardWriter(folder, task.partitionId(), f"{task.taskAttemptId()}-{os.getpid()}", layout)
                shard.add(doc_id, np.frombuffer(encoder.encode(text.as_py()) + end, "<u4"))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_ids": [shard.n_ids]})

    sizes = sorted(map(tuple, rows.mapInArrow(write, "shard long, n_ids long").collect()))  # a row a shard
    starts, before = [], 0
    for shard, n in sizes:
        starts.append((shard, before))
        before += n
    return starts


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int]]) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as uint32)."""
    small_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    known = spark.sparkContext.broadcast(shards)  # 16 bytes a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, before = known.value[k]
                with store.open_input_stream(f"{root}/shard-{shard:06d}.docs") as f:
                    table = pa.ipc.open_stream(f).read_all()
                starts, lengths = (table.column(c).to_numpy() for c in (1, 2))
                sums = np.zeros(len(starts), np.int64)
                with store.open_input_stream(f"{root}/shard-{shard:06d}.ids") as f:
                    done, held, base = 0, np.zeros(0, "<u4"), 0
                    for b in pa.ipc.open_stream(f):
                        got = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<u4")
                        held, cut = np.concatenate([held, got]), 0
                        while done < len(starts) and starts[done] + lengths[done] <= base + len(held):
                            cut = int(starts[done] - base)
                            sums[done] = zlib.crc32(held[cut : cut + int(lengths[done])])
                            cut += int(lengths[done])
                            done += 1
                        held, base = held[cut:], base + cut
                for i in range(0, len(starts), 10_000):
                    s = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks()[s], pa.array(starts[s] + before), pa.array(lengths[s]), pa.array(sums[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)


def token_file_index(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, layout: Layout = Layout()) -> DataFrame:
    """Write docs into a new folder of the shared folder and read the documents' places and sums back."""
    folder = new_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer_path, end_id, folder, layout))
