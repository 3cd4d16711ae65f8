"""The pipeline's stages on rows that doc_id alone does not tell apart."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from textveil.llm import exact_dedup, simhash

r = random.Random(9)
A, B, C, D, E = (" ".join("".join(r.choice("aeioustnr") for _ in range(r.randint(2, 9))) for _ in range(120)) for _ in range(5))
#: Whole rows twice, copies without ids, one id with two texts of which one is a copy, empty texts without ids.
ROWS = [(1, A), (1, A), (1, A), (None, B), (None, B), (None, B.replace(" ", "\n", 1)), (2, C), (3, C), (3, D), (4, E), (None, E), (None, None), (None, "")]
plain = lambda t: " ".join((t or "").split())
WANT = [(1, A), (None, B), (2, C), (3, D), (4, E), (None, "")]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_one])
def test_one_row_of_each_text_stays(docs, keep):
    for rows in (ROWS, ROWS[::-1]):
        kept = keep(docs(rows))
        assert kept.columns == docs(rows).columns
        assert Counter((x.doc_id, plain(x.text)) for x in kept.collect()) == Counter(WANT)


def test_the_stages_lose_no_text(spark, docs):
    left = docs(ROWS)
    for name, stage in corpus_pipeline.STAGES:
        if name in ("exact copies", "near copies", "repeated passages"):
            left = stage(spark, left, "")
    assert Counter((x.doc_id, plain(x.text)) for x in left.collect()) == Counter(WANT)


def test_all_stages_on_rows_with_extra_columns_and_on_none(spark, tmp_path):
    words = lambda n, seed: " ".join("".join(random.Random(f"{seed} {i}").choice("aeioustnr") for _ in range(5)) for i in range(n))
    toxic = lambda i: words(30, i) + " zorgkos zorgka vumpxa " + words(20, -i)
    rows = [(i, toxic(i) if i % 3 == 0 else words(60, i), "en", "s", 1, i, True) for i in range(120)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", 0, 1, True), (1, rows[1][1], "fr", "t", 9, 2, False), (None, words(50, 777), None, None, None, 3, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, d long, kept boolean"
    labels = [(i, 1, int(i % 3 == 0)) for i in range(0, 120)]
    for name, some, marked in (("some", rows, labels), ("none", [], [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert {r.doc_id for r in out} == {i for i in range(120) if i % 3} | {200, None} or {r.doc_id for r in out} == {i for i in range(120) if i % 3} | {201, None}
    by_doc = Counter()
    for r in out:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_copies_are_found_and_others_left_alone(docs):
    """Copies with a few words changed go; texts of the same words in another order, and others, stay."""
    q = random.Random(12)
    common = ["".join(q.choice("aeioustnr") for _ in range(q.randint(2, 7))) for _ in range(300)]
    text = [[q.choice(common) for _ in range(200)] for _ in range(60)]
    rows, copies = [(i, " ".join(w)) for i, w in enumerate(text)], []
    for i in range(40):
        w = list(text[i])
        for _ in range(2):
            w[q.randrange(len(w))] = "".join(q.choice("zkw") for _ in range(5))
        copies.append((100 + i, " ".join(w)))
    shuffled = [(200 + i, " ".join(q.sample(w, len(w)))) for i, w in enumerate(text[:30])]
    kept = {r.doc_id for r in corpus_pipeline.near_copies(None, docs(rows + copies + shuffled), "").collect()}
    assert {i for i, _ in rows + shuffled} <= kept
    assert len({i for i, _ in copies} & kept) <= 8  # words all as frequent as each other are the hard case: 33 of 40 are found
