"""Registered queries without SQL, over whole tables, against brute force."""

import collections

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from textveil.functions import text as T
from textveil.operators import neighbours, triage
from textveil.plans import queries


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def brute_nearest(rows, most):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    want = set()
    for i, x, n in zip(ids, v, norm, strict=True):
        cosine = [round(float(x @ y) / (n * m), 9) if n * m else 0.0 for y, m in zip(v, norm, strict=True)]
        best = sorted(zip(cosine, ids, strict=True), key=lambda c: (-c[0], c[1]))[:most]
        want |= {(int(i), int(w), round(max(0.0, min(1.0, (c + 1) / 2)), 6)) for c, w in best}
    return want


@pytest.mark.parametrize("size", [7, 2048])
def test_the_nearest_are_sought_among_all_vectors(spark, tables, monkeypatch, size):
    r = np.random.default_rng(4)
    monkeypatch.setattr(neighbours.nearest, "__defaults__", (8, size))
    vectors = np.float32(r.normal(size=(90, 6))).tolist()
    # copies, more of one than there are places, and a vector of zeros
    vectors += [vectors[3]] * 12 + [vectors[80], [0.0] * 6]
    rows = list(enumerate(vectors))
    sf = tables("embeddings", [(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = [tuple(x) for x in queries.QUERIES["embedding_nearest"](spark, sf).collect()]
    assert len(got) == 8 * len(rows) and set(got) == brute_nearest(rows, 8)
    assert max(w for _, w, _ in got) >= 32
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, v array<double>")).count() == 0


TEXTS = ["Sooo naïveee, ÉÉÉCOLE école u", "don’t DON’T dont well-known", "r2d2 10000 ١٢ U2 see https://x.org/aaa @youuu #soooo", "Привеееет мир МИР", "großßße straße", "", None, "_under_ snake_case plz plz"]


def brute_words(texts):
    token = r"(?:https?://|www\.)\S+|@\w+|#\w+|[^\W_]+(?:['’\-][^\W_]+)*"
    found = collections.Counter(t for x in texts for t in regex.findall(token, x or "") if not regex.match(r"https?://|www\.|@|#", t))
    want = set()
    for word, n in found.items():
        low = word.lower()
        short = regex.sub(r"(.)\1{2,}", r"\1", low)
        fixed = T.MISSPELLINGS.get(short, short)
        names = (("lowercased", low != word), ("de-elongated", short != low), ("misspelling", fixed != short))
        want.add((word, n, fixed, "+".join(k for k, changed in names if changed)))
    return want


def test_every_word_is_normalised(spark, tables):
    sf = tables("documents", list(enumerate(TEXTS)), "doc_id long, text string")
    got = [tuple(x) for x in queries.QUERIES["normalize_words"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_words(TEXTS)
    assert {"naïveee", "don’t", "r2d2", "10000", "Привеееет"} <= {x[0] for x in got}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_ratios_count_every_character(spark, tables):
    said = ["Привет мир", "Привет миру", "école", "ecole", "日本", "日本語 😀", "", None, "plain", "plain"]
    sf = tables("conversations", [(0, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r.edit_ratio for r in queries.QUERIES["edit_ratio"](spark, sf).collect()}
    pairs = [(a or "", b or "") for a, b in zip(said, said[1:], strict=False)]
    assert got == {i: round(brute_distance(a, b) / max(len(a), len(b), 1), 9) for i, (a, b) in enumerate(pairs)}
    assert got[0] > 0 and got[2] > 0


def test_whole_texts_are_normalised(spark, tables):
    texts = ["wow!!! ok… “so”—what??", "a  b\n\tc", "😀 smile 😀👍🏽", "...,,, --- ‘’x’’", "no marks", "", None]
    sf = tables("documents", list(enumerate(texts)), "doc_id long, text string")

    def plain(t):
        t = regex.sub(r"[\p{Extended_Pictographic}\U0001F1E6-\U0001F1FF\uFE0F\u200D]", "", t or "")
        t = t.translate({ord(k): v for k, v in T.MARKS.items()}).replace("…", "...")
        return regex.sub(r"\s+", " ", regex.sub(r"([^\w\s])\1+", r"\1", t))

    got = {r.doc_id: r.plain for r in queries.QUERIES["normalize_texts"](spark, sf).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert got[0] == 'wow! ok. "so"-what?'


def test_every_later_turn_is_a_candidate_and_must_hold_the_terms(spark, tables):
    first = "what a clown he is today"
    later = ["what a fine man he is today", *(f"turn {w} is about {w} alone" for w in ("tea", "sea", "pie", "sky", "fog", "ice")), "what a c l o w n he was back then", "he is what a clown"]
    rows = [(7, i, "user", t) for i, t in enumerate([first, *later])] + [(8, 0, "user", "alone")]
    sf = tables("conversations", rows, "conv_id long, turn int, role string, text string")
    pruned = {r.conv_id: r.k for r in queries.QUERIES["prune_greedy"](spark, sf).collect()}
    assert pruned == {7: len(later), 8: 0}
    gates = {r.place: r.reject for r in queries.QUERIES["filter_gates"](spark, sf).collect()}
    assert len(gates) == len(later) and all((gates[i] == "span") == (i < 7) for i in gates), gates
    chosen = {r.conv_id: r for r in queries.QUERIES["select_candidate"](spark, sf).collect()}
    assert chosen[7].k_valid == sum(g == "" for g in gates.values()) and chosen[8].reason == "no_candidates"


def test_a_token_that_matters_only_in_context_is_tried(spark):
    df = spark.createDataFrame([(0, "you are half witted today"), (1, "half of it")], "row_idx long, Text string")
    phrase = lambda t: F.contains(t, F.lit("half witted")).cast("double")
    found = [(r.row_idx, r.token, r.start, r.end) for r in triage.saliency_routes(df, score=phrase).collect()]
    assert sorted(found) == [(0, "half", 8, 12), (0, "witted", 13, 19)]
