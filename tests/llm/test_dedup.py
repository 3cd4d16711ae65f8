"""Exact copies, near copies, components and repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from textveil.llm import common, exact_dedup, simhash, suffix_dedup
from textveil.llm.components import components


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_exact_copies(spark, docs, texts, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = [*texts, (2, texts[2][1]), (None, texts[3][1]), (None, "alone")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs(rows)).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = exact_dedup.keep_first(docs(texts))
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3] and w[0] is not None}
    assert kept.columns == docs(texts).columns
    assert exact_dedup.exact_duplicates(docs([])).count() == 0


def test_no_round_shuffles_texts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "written", lambda s, df, label: plans.append(df) or common.written(s, df, label))
    plans = []
    plans.append(exact_dedup.exact_duplicates(docs(texts)))
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joined = [line for line in plan.splitlines() if "Join" in line]
        assert not any("text#" in line for line in joined), plan


def test_a_hot_length_and_prefix_is_split_by_the_full_hash(docs):
    rows = [(i, "p" * 80 + str(i % 7)) for i in range(200)]
    out = exact_dedup.exact_duplicates(docs(rows)).collect()
    assert all(r.keep_id == r.doc_id % 7 for r in out)


def plain_print(text, words=3):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("radius", [0, 2])
def test_near_copies(spark, docs, texts, radius):
    rows = [*texts, (3, texts[3][1]), *((500 + i, t.upper()) for i, t in texts[:5])]
    prints = [plain_print(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in part}
    want = sorted((i, f"{f:016x}", least[p]) for (i, _), f, p in zip(rows, prints, part, strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(docs(rows), radius=radius).collect())) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_links_within_and_between_tiles(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(20)} | set(base)
    found = simhash.links(spark.createDataFrame([(f"{v:016x}",) for v in values], "fp string"), 2, tile=4).collect()
    unsigned = lambda x: int(x, 16)
    assert all((unsigned(x.a) ^ unsigned(x.b)).bit_count() <= 2 for x in found)

    def parts(pairs):
        part = {v: v for v in values}

        def root(v):
            while part[v] != v:
                v = part[v]
            return v

        for a, b in pairs:
            part[root(a)] = root(b)
        return {frozenset(v for v in values if root(v) == k) for k in map(root, values)}

    every = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    assert parts([(unsigned(x.a), unsigned(x.b)) for x in found]) == parts(every)


@pytest.mark.parametrize("radius", [3, 5])
def test_a_check_confirms_links(spark, docs, texts, radius):
    check = simhash.Check(words=5, radius=24)
    rows = [(i, t or "") for i, t in texts] + [(600 + k, texts[k][1].replace("a", "A", 1) + " more words") for k in range(12)]
    records = [simhash._record(t, 1, check) for _, t in rows]
    apart = lambda x, y, s: (int.from_bytes(x[s], "big") ^ int.from_bytes(y[s], "big")).bit_count()
    part = list(range(len(rows)))
    for i, x in enumerate(records):
        for j in range(i):
            if x == records[j] or apart(x, records[j], slice(8)) <= radius and apart(x, records[j], slice(8, 24)) <= 24:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    assert len(set(part)) < len({t for _, t in rows}) - 8
    kept = simhash.keep_one(docs(rows), 1, radius, check)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in part}.values())


def test_a_large_group_passes_on_a_forest():
    import numpy as np

    r = np.random.default_rng(1)
    a = (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64)).reshape(-1, 1)
    found = list(simhash._forest(a, a, 2, True, None))
    assert len(found) == len(a) - 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 4), *((100 + i, 101 + i) for i in range(30)), *((1000, 1001 + i) for i in range(30))]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {v: 1 for v in (1, 2, 3, 4, 20)} | {10: 10, 11: 10} | {100 + i: 100 for i in range(31)} | {1000 + i: 1000 for i in range(31)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for k in range(len(r) - window + 1):
            seen[r[k : k + window]] = seen.get(r[k : k + window], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [2, 16384])
def test_repeated_passages(spark, docs, texts, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (400, 100, largest))
    rows = [(i, t) for i, t in texts] + [(0, texts[0][1]), (777, "é" * 300), (778, "zé" * 250), (779, "x" * 399)]
    got = sorted(tuple(r) for r in suffix_dedup.repeat_report(docs(rows)).collect())
    want = sorted((i, *f) for (i, _), f in zip(rows, plain_removed([t for _, t in rows], 400), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_construction_finds_every_repeated_window(seed):
    r = random.Random(seed)
    window, gram = 24, 8
    base = [bytes(r.choice(b"ab") for _ in range(200)) for _ in range(3)]
    rows = [(d + 0, 30 + r.randrange(10), bytearray(r.choice(base)[:60]), 1) for d in range(12)]
    strings = sorted((k % 3, 10, bytes(x[2][10 - r.randrange(5) :][:50]), 1) for k, x in enumerate(rows))
    found = suffix_dedup.repeated_windows(strings, window)
    for i, (anchor, place, data, _) in enumerate(strings):
        for s in range(len(data) - window + 1):
            twice = any(
                j != i and a == anchor and p - place + s >= 0 and d[p - place + s : p - place + s + window] == data[s : s + window]
                for j, (a, p, d, _) in enumerate(strings)
            )
            assert twice == any(a <= s < b for a, b in found[i]), (i, s)


def test_texts_without_their_repeats(docs, texts):
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(texts)).collect()}
    assert out[26].text is not None and suffix_dedup.remove_repeats(docs(texts)).columns == docs(texts).columns
    for (i, t), (n, gone, _, _) in zip(texts, plain_removed([t for _, t in texts], 400), strict=True):
        assert (out[i].text == t) if not gone else len(out[i].text.encode()) <= n - gone
        assert out[i].n_chars == (None if t is None else len(out[i].text))
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_shorter_repeats_stay(docs):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("aeioustnr") for _ in range(r.randint(2, 9))) for _ in range(n))
    long, short = prose(60), prose(45)
    rows = [(0, prose(80) + "\n" + long + "\n" + prose(30)), (1, prose(20) + "\n" + long), (2, prose(50) + "\n" + short + "\n" + prose(9)), (3, short + "\n" + prose(70))]
    out = {x.doc_id: x.text for x in suffix_dedup.remove_repeats(docs(rows), window=200, words=51).collect()}
    assert long not in out[0] and long not in out[1]
    assert all(len(out[i].split()) >= len(t.split()) - 62 for i, t in rows) and [out[2], out[3]] == [rows[2][1], rows[3][1]]
