"""Repeated passages: every byte covered by a string of `window` bytes that also starts anywhere else.

The collection is built column by column over many documents at once: each round inserts one symbol of every string,
right to left, and updates the order of the strings' suffixes, the symbols in that order (the round's segment of the
collection's Burrows-Wheeler transform) and the common prefixes of neighbours. Symbols come from one sequential file
and every round's segment goes to another, which a last sequential pass reads for common prefixes of `window` bytes.

What makes this possible for whole corpora is where the strings come from. In each window the 100-byte string with
the least hash (the leftmost of equals) is its anchor. Equal windows have equal anchors at equal places, so only
strings around an anchor that occurs twice need comparing, and once they are aligned at the anchor, equal windows
start in the same column. A suffix thus only competes with suffixes of its own round, and a round costs its strings,
not the collection so far. The plain construction over whole documents takes as many rounds as the longest document
has bytes, each over the whole collection, which no cluster affords; the README says so.

Steps, all as tables: anchors with hashes of their strings (no text) are counted; strings that occur twice as a whole
are repeated without more ado; the rest, where an anchor has several, are cut from the texts, gathered by anchor in
bounded bundles and built as above. An anchor with too many different strings for a bundle is split: its windows
are halved by where they start, each half keyed by the bytes that all its windows share, until every part is small
or holds single windows, which are compared as a whole. The documents are shuffled twice, filtered each time.

Defined cases: a null text is empty; texts shorter than the window lose nothing; repeated rows are elsewhere for each
other, so both lose what they share; rows that share a doc_id but not the text are apart; an empty table gives no
rows; other columns, whatever their names, pass through remove_repeats() and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import discard, only, small_batches, written, written_at

WINDOW, GRAM = 400, 100
#: Windows hashed at a time; bounds memory for long texts.
SLICE = 1 << 18
#: Strings in a bundle, and of one anchor before it is split.
BUNDLE, LARGEST = 4096, 16384

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """Hashes of all strings of `gram` bytes, and each window's anchor."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_BASE, inverse))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
            n = len(data) - self.gram + 1
            found = (sums[self.gram :] - sums[:n]) * self.inverse[:n]
            found ^= found >> np.uint64(32)
            found *= _MIX
            found ^= found >> np.uint64(29)
        return found

    def anchors(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """hash, place, first window and number of windows of the anchors; a slice of the text at a time."""
        reach = self.window - self.gram + 1
        for begin in range(0, len(data) - self.window + 1, SLICE):
            end = min(begin + SLICE, len(data) - self.window + 1)
            hashes = self.hashes(data[begin : end + self.window - 1])
            least = hashes >> np.uint64(20) << np.uint64(20) | np.arange(len(hashes), dtype=np.uint64)
            width = 1
            while 2 * width <= reach:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < reach:
                least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
            places = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(places)]]))
            yield hashes[places[starts]], places[starts] + begin, starts + begin, counts


def repeated_windows(strings: list[tuple[int, int, bytes, int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each of strings (anchor, place of the anchor in it, bytes, copies), ranges of its windows that repeat.

    strings are in order of anchor. Windows are compared among the strings of one anchor.
    """
    m = len(strings)
    middle = max(s[1] for s in strings)
    width = max(middle - s[1] + len(s[2]) for s in strings)
    table = np.full((m, width), 256, np.uint16)
    for i, (_, place, data, _) in enumerate(strings):
        table[i, middle - place : middle - place + len(data)] = np.frombuffer(data, np.uint8)
    owner = np.unique(np.array([s[0] for s in strings], np.int64), return_inverse=True)[1].astype(np.int64)
    block = np.sort(owner, kind="stable")  # of each position in the order; blocks never move
    order = np.argsort(owner, kind="stable").astype(np.int32)
    common = np.zeros(m + 1, np.int32)
    last_start = width - window
    flagged = np.zeros((m, max(0, last_start + 1)), bool)
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as segments:
        for column in range(width - 1, -1, -1):
            symbols.write(table[:, column].tobytes())
        del table
        symbols.seek(0)
        for column in range(width - 1, -1, -1):
            inserted = np.frombuffer(symbols.read(2 * m), np.uint16)[order]  # the round's segment of the transform
            keys = block * 512 + inserted
            same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (inserted[1:] != 256), [False]])
            if np.all(keys[1:] >= keys[:-1]):
                common = np.where(same, common + 1, 0).astype(np.int32)
            else:
                moved = np.argsort(keys, kind="stable")
                sorted_keys = keys[moved]
                same = np.concatenate([[False], (sorted_keys[1:] == sorted_keys[:-1]) & (sorted_keys[1:] % 512 != 256), [False]])
                # a suffix and the next one with the same symbol share what all neighbours between them shared
                pairs = np.flatnonzero(same[:m])
                new = np.zeros(m + 1, np.int32)
                if len(pairs):
                    ends = np.stack([moved[pairs - 1] + 1, moved[pairs] + 1], axis=1).ravel()
                    new[pairs] = np.minimum.reduceat(common, ends)[::2] + 1
                common, order = new, order[moved]
            if column <= last_start:
                segments.write(order.tobytes())
                segments.write(common.tobytes())
        segments.seek(0)
        for column in range(last_start, -1, -1):
            placed = np.frombuffer(segments.read(4 * m), np.int32)
            shared = np.frombuffer(segments.read(4 * m + 4), np.int32)
            flagged[placed, column] = np.maximum(shared[:-1], shared[1:]) >= window
    out = []
    for i, (_, place, data, copies) in enumerate(strings):
        first, n = middle - place, len(data) - window + 1
        own = np.ones(n, bool) if copies > 1 else flagged[i, first : first + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t name a row by its doc_id and text; rows that repeat both stand for each other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"), doc_id.alias("doc_id"))


def _anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """d, t, anchor, place, first, n, whole: an anchor of a text, where it lies in its string, the string's first window,
    its number of windows and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        grams = Grams(window, gram)
        for batch in batches:
            held: list[tuple] = []
            n_held = 0
            for d, t, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw = memoryview(text.as_buffer())
                if len(raw) < window:
                    continue
                for anchor, place, first, n in grams.anchors(np.frombuffer(raw, np.uint8)):
                    whole = [xxhash.xxh3_64_intdigest(raw[a : a + k]) for a, k in zip(first.tolist(), (n + window - 1).tolist(), strict=True)]
                    ids = (np.full(len(n), x.as_py(), np.int64) for x in (d, t))
                    held.append((*ids, anchor.view(np.int64), (place - first).astype(np.int32), first, n.astype(np.int32), np.array(whole, np.uint64).view(np.int64)))
                    n_held += len(n)
                if n_held >= 50_000:
                    yield _columns(held)
                    held, n_held = [], 0
            if held:
                yield _columns(held)

    return rows.select("d", "t", "text").mapInArrow(run, "d long, t long, anchor long, place int, first long, n int, whole long")


def _columns(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["d", "t", "anchor", "place", "first", "n", "whole"])


STRING = "d long, t long, anchor long, place int, first long, n int, copies long, data binary"


def _cut(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted with the bytes of its strings."""
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "place", "first", "n", "copies")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for d, t, text, strings in zip(*(batch.column(c) for c in range(4)), strict=True):
                raw, d, t = memoryview(text.as_buffer()), d.as_py(), t.as_py()
                for s in strings.as_py():
                    data = bytes(raw[s["first"] : s["first"] + s["n"] + window - 1])
                    out.append((d, t, s["anchor"], s["place"], s["first"], s["n"], s["copies"], data))
                    size += len(data)
                    if size > 4_000_000:
                        yield _strings(out)
                        out, size = [], 0
            if out:
                yield _strings(out)

    texts = rows.join(lists, ["d", "t"]).select("d", "t", "text", "wanted")
    return texts.mapInArrow(run, STRING)


def _strings(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in STRING.split(", ")])


def _build(strings: DataFrame, window: int) -> DataFrame:
    """d, t, a, b: spans that the construction finds among the strings of each anchor."""

    def spans(bundle: list[tuple]) -> pa.RecordBatch | None:
        found = repeated_windows([(s[2], s[3], s[7], s[6]) for s in bundle], window)
        rows = [(s[0], s[1], s[4] + a, s[4] + b - 1 + window) for s, ranges in zip(bundle, found, strict=True) if s[6] == 1 for a, b in ranges]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d", "t", "a", "b"]) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: list[tuple] = []
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[2] != group[0][2]:
                    bundle += group
                    group = []
                    if len(bundle) >= BUNDLE:
                        if out := spans(bundle):
                            yield out
                        bundle = []
                group.append(row)
        bundle += group
        if bundle and (out := spans(bundle)):
            yield out

    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "d long, t long, a long, b long")


def _split(strings: DataFrame, level: int, window: int) -> DataFrame:
    """Halves of strings by where their windows start before the anchor, keyed by what all windows of a half share."""
    size = 512 >> level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for d, t, anchor, place, first, n, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range((place - n + 1) // size * size, place + 1, size):
                    # the windows that start low .. low + size - 1 bytes before the anchor
                    i, k = max(0, place - low - size + 1), min(n - 1, place - low)
                    shared = data[place - low : place - low - size + 1 + window]
                    key = xxhash.xxh3_64_intdigest(shared + anchor.to_bytes(8, "little", signed=True), seed=low)
                    out.append((d, t, key - (1 << 64) if key >> 63 else key, place - i, first + i, k - i + 1, copies, data[i : k + window]))
                if len(out) > 5000:
                    yield _strings(out)
                    out = []
            if out:
                yield _strings(out)

    return strings.mapInArrow(run, STRING)


def _counted(strings: DataFrame, copies: Column) -> DataFrame:
    """One row for each different string of an anchor: its copies and the first place that holds it."""
    return strings.groupBy("anchor", "place", "n", "whole").agg(copies.alias("copies"), F.min(F.struct("d", "t", "first")).alias("at"))


def _several(counted: DataFrame) -> DataFrame:
    """Anchors with different strings, one of which isn't known to repeat."""
    return counted.groupBy("anchor").agg(F.count("*").alias("strings"), F.max(F.col("copies") == 1).alias("open")).where("strings > 1 and open").select("anchor", "strings")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """d, t, spans (array of a, b; unmerged) of each text with repeats."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _keyed(docs)
    found, every = written_at(spark, _anchor_rows(rows, window, gram), "anchors")
    # written first: joined as a table of its own, a hot anchor's rows can be split over tasks
    twice, known = written_at(spark, found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors-known")
    found = written(spark, only(found, twice, ["anchor"]), "anchors-twice")
    for path in (every, known):
        discard(spark, path)
    counted = written(spark, _counted(found, F.count("*")), "anchor-strings")
    name = ["anchor", "place", "n", "whole"]
    span = [F.col("d"), F.col("t"), F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + window).alias("b")]
    out = only(found, counted.where("copies > 1").select(*name), name).select(*span)

    several = _several(counted)
    wanted = counted.join(several, "anchor").select("anchor", "place", "n", "copies", "at.*", "strings")
    strings = _cut(rows, wanted.where(F.col("strings") <= largest), window)
    out = out.unionByName(_build(strings, window))
    hot = several.where(F.col("strings") > largest)
    level = 0
    if not hot.isEmpty():
        hot_strings = written(spark, _cut(rows, wanted.where(F.col("strings") > largest), window), "anchors-hot")
        while level < 9 and not hot_strings.isEmpty():
            level += 1
            halves = written(spark, _split(hot_strings, level, window).withColumn("whole", F.xxhash64("data")), "anchors-halves")
            counted = written(spark, _counted(halves, F.sum("copies")), "anchor-halves-strings")
            repeated = only(halves.where("copies = 1"), counted.where("copies > 1").select(*name), name)
            out = out.unionByName(repeated.select(*span))
            several = _several(counted)
            ones = halves.select("d", "t", "first", *name, "data").join(counted.select(*name, "copies", F.col("at.d").alias("d"), F.col("at.t").alias("t"), F.col("at.first").alias("first")), [*name, "d", "t", "first"])
            ones = ones.join(several, "anchor").select(*(x.split()[0] for x in STRING.split(", ")), "strings")
            out = out.unionByName(_build(ones.where(F.col("strings") <= largest).drop("strings"), window))
            hot_strings = written(spark, ones.where(F.col("strings") > largest).drop("strings"), "anchors-hot")
    return out.groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[dict] | None, words: int = 0) -> tuple[bytes, int, int]:
    """What stays, how many bytes went, in how many runs; runs of fewer words than given stay."""
    runs = merged([(s["a"], s["b"]) for s in (() if spans is None else spans)])
    if words:
        runs = [(a, b) for a, b in runs if len(raw[a:b].split()) >= words]
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    kept = b"".join([*parts, raw[at:]])
    return kept, len(raw) - len(kept), len(runs)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    joined = _keyed(docs).join(repeated_spans(docs, window), ["d", "t"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw = memoryview(text.as_buffer())
                kept, removed, runs = kept_bytes(bytes(raw), spans.as_py())
                rows.append((doc_id.as_py(), len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int | None = None, words: int = 0) -> DataFrame:
    """docs with the repeated bytes of text gone (and n_chars recounted, if there is one); a character that loses a
    byte goes with it. Rows without repeats are as they were.

    gram: bytes of an anchor, a quarter of the window unless given. words: runs of fewer words stay."""

    @F.pandas_udf("string")
    def without(texts, spans):
        import pandas as pd

        return pd.Series([None if t is None else t if s is None else kept_bytes(t.encode(), s, words)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    packed = docs.select(F.struct("*").alias("row")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("t"))
    joined = packed.join(repeated_spans(docs, window, gram or window // 4), ["d", "t"], "left")
    joined = joined.select("row", without(F.col("row.text"), F.col("spans")).alias("new_text"))
    fields = []
    for c in docs.columns:
        new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema[c].dataType)}.get(c, F.col("row")[c])
        fields.append(new.alias(c))
    return joined.select(*fields)
