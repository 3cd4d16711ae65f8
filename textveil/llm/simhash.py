"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in one pass over the texts. Equal fingerprints are merged first, so copies, however many, cost
one row. The distinct fingerprints are tiled by the population counts of their four 16-bit words, and tiles are cut to
a bounded number of fingerprints. The population counts of two words differ by no more than their bits do, so two
tiles whose four counts differ by more than the radius in sum hold no link and are never brought together; all other
pairs of cuts are compared in full with exclusive-or and bit counts, each pair in a group of its own, so that a hot
tile is spread. A pair passes on a spanning forest of its links, which keeps every component and at most one row a
fingerprint.

A check, if given, is a second, wider fingerprint of other shingles, which linked fingerprints must confirm: frequent
words make many texts alike by a fingerprint of single words, which in return hardly moves under small edits.

Defined cases: a null or empty text, or one of blanks, has fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle; repeated rows give a row each, and keep_one() keeps one of them; an empty
table gives no rows; other columns pass through keep_one() and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import id_and_text, one_of_each, row_key, small_batches, written
from textveil.llm.components import components

SEED = 42
#: Fingerprints in a tile at most (about; tiles are cut by a hash).
TILE = 2048
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Check:
    """128 bits over shingles of words, of which linked fingerprints may differ in radius."""

    words: int
    radius: int


#: Five words and a similarity of 0.8 or more: such sets have a cosine of 0.89 or more, so 128 bits differ in 19.4 of
#: them on average or fewer, with a deviation of 4; one deviation is allowed.
FIVE_WORDS = Check(words=5, radius=24)


def _shingles(text: str, words: int) -> list[bytes]:
    tokens = text.translate(_LOWER).encode().split()
    if words == 1 or not tokens:
        return tokens
    return list(map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))) if len(tokens) >= words else [b" ".join(tokens)]


def _majority(hashes: np.ndarray) -> bytes:
    """hashes: a row of bytes for each hash. The bits that are set in over half of them."""
    n = len(hashes)
    total = np.zeros(8 * hashes.shape[1], np.int64)
    for k in range(0, n, 65536):
        total += np.unpackbits(hashes[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; repeated shingles count each time."""
    return int.from_bytes(_record(text, words, None), "big")


def _record(text: str, words: int, check: Check | None) -> bytes:
    """The fingerprint's 8 bytes, and the check's 16."""
    import xxhash

    shingles = _shingles(text, words)
    if not shingles:
        return bytes(24 if check else 8)
    digest = xxhash.xxh64_intdigest
    out = _majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)).astype(">u8").view(np.uint8).reshape(-1, 8))
    if check:
        wide = xxhash.xxh3_128_digest
        out += _majority(np.frombuffer(b"".join([wide(s, SEED) for s in _shingles(text, check.words)]), np.uint8).reshape(-1, 16))
    return out


def _printed(rows: DataFrame, words: int, check: Check | None = None) -> DataFrame:
    """rows (longs, and the text last) with the fingerprint and the check, fp, as hexadecimal digits in place of the text."""
    small_batches(rows.sparkSession)
    names = [*rows.columns[:-1], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_record(t, words, check).hex() for t in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'fp' else 'long'}" for c in names))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as 16 hexadecimal digits."""
    return _printed(id_and_text(docs), words)


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, check: Check | None) -> Iterator[tuple[int, int]]:
    """Places in a and b of a spanning forest of their links (or of those within a, if same).

    a and b hold a row of words for each fingerprint: the first is the fingerprint, the other two are the check.
    """
    part = np.arange(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    step = max(1, 1 << 20 >> max(0, int(len(b)).bit_length()))
    for k in range(0, len(a), step):
        near = np.bitwise_count(a[k : k + step, None, 0] ^ b[None, :, 0]) <= radius
        if same:
            near &= np.arange(k, min(k + step, len(a)))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(near)
        if check and len(i):
            apart = sum(np.bitwise_count(a[k + i, w] ^ b[j, w]).astype(np.int32) for w in (1, 2))
            i, j = i[apart <= check.radius], j[apart <= check.radius]
        edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else []
        for own in np.split(np.arange(len(i)), edges[1:]) if len(i) else []:
            x, others = k + i[own[0]], j[own]
            roots, at = np.unique(part[others + shift], return_index=True)
            for root, y in zip(roots, others[at], strict=True):
                if root != part[x]:
                    yield int(x), int(y)
                    part[part == root] = part[x]


def links(distinct: DataFrame, radius: int = 2, tile: int = TILE, check: Check | None = None) -> DataFrame:
    """a, b: links between fingerprints (fp) that differ in radius bits or fewer, enough of them to join each component."""
    spark = distinct.sparkSession
    part = [F.bit_count(F.conv(F.substring("fp", 4 * k + 1, 4), 16, 10).cast("int")).cast("int") for k in range(4)]
    counted = distinct.select("fp", *(p.alias(f"p{k}") for k, p in enumerate(part)))
    key = F.expr("p0 + 17 * (p1 + 17 * (p2 + 17 * p3))")
    counted = counted.withColumn("tile", key)
    sizes = counted.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("cuts"))
    sizes = F.broadcast(written(spark, sizes, "tile-sizes"))  # at most 17 ** 4 rows of two integers
    cut = counted.join(sizes, "tile").withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = cut.groupBy("tile", "p0", "p1", "p2", "p3", "cut").agg(F.array_join(F.collect_list("fp"), "").alias("hex"))
    tiles = written(spark, tiles.select("tile", "p0", "p1", "p2", "p3", "cut", F.unhex("hex").alias("fps")), "tiles")

    # each unordered pair of tiles once: only steps whose first difference is positive, and the step of zero
    steps = [s for s in np.ndindex(*(2 * radius + 1,) * 4) if sum(abs(int(x) - radius) for x in s) <= radius]
    steps = [tuple(int(x) - radius for x in s) for s in steps]
    steps = [s for s in steps if s >= (0, 0, 0, 0)]
    moved = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(s))) for s in steps)))
    inside = " and ".join(f"p{k} + step.d{k} between 0 and 16" for k in range(4))
    near = tiles.select("tile", "cut", "p0", "p1", "p2", "p3", moved.alias("step")).where(inside).selectExpr(
        "tile as a_tile", "cut as a_cut", "p0 + step.d0 + 17 * (p1 + step.d1 + 17 * (p2 + step.d2 + 17 * (p3 + step.d3))) as b_tile"
    )
    near = near.join(sizes.withColumnRenamed("tile", "b_tile"), "b_tile").withColumn("b_cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    near = near.where("a_tile <> b_tile or a_cut <= b_cut").select("a_tile", "a_cut", "b_tile", "b_cut")
    left = near.join(tiles.selectExpr("tile as a_tile", "cut as a_cut", "fps as a_fps"), ["a_tile", "a_cut"])
    pairs = left.join(tiles.selectExpr("tile as b_tile", "cut as b_cut", "fps as b_fps"), ["b_tile", "b_cut"])
    pairs = pairs.selectExpr("a_fps", "b_fps", "a_tile = b_tile and a_cut = b_cut as same")
    width = 24 if check else 8

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str]] = []
            for a, b, same in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw = [v.as_buffer().to_pybytes() for v in (a, b)]
                x, y = (np.frombuffer(v, ">u8").astype(np.uint64).reshape(-1, width // 8) for v in raw)
                for i, j in _forest(x, y, radius, same.as_py(), check):
                    found.append((raw[0][width * i : width * (i + 1)].hex(), raw[1][width * j : width * (j + 1)].hex()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["a", "b"])

    small_batches(spark)
    return pairs.mapInArrow(compare, "a string, b string")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, words), "fingerprints")
    classes = written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    placed = classes.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, check: Check | None = None) -> DataFrame:
    """docs with exactly one row of each component, one with the smallest doc_id; all columns as they were."""
    spark = docs.sparkSession
    prints = written(spark, _printed(docs.select(*row_key(), F.coalesce(F.col("text"), F.lit("")).alias("text")), words, check), "fingerprints")
    classes = written(spark, prints.select("fp").distinct(), "classes")
    roots = components(links(classes, radius, check=check))
    placed = classes.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, prints.join(placed, "fp"), ["root"])
