"""Corpus files in and out, term lists, resuming."""

import pytest
from pyspark.sql import functions as F

from textveil.config import TokenConfig
from textveil.operators import privatize
from textveil.sources import csv, terms
from textveil.streaming import resume

ROWS = [("1", "Zoë, B", 'say "hi", then\nleave', "0", "x"), ("2", "b", "", "1", ""), ("3", "c", "tab\there 😀", "0", "a,b")]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "ID string, Author string, Text string, HS string, more string")


def test_round_trip(spark, frame, tmp_path):
    csv.write_corpus(frame, str(tmp_path / "c"), one_file=True)
    back = csv.read_corpus(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == ROWS and back.columns == frame.columns


def test_aliases(spark, frame, tmp_path):
    csv.write_corpus(frame.drop("more"), str(tmp_path / "c"), {"Author": "author", "Text": "text", "HS": "hs"}, one_file=True)
    back, names = csv.read_compatible(spark, str(tmp_path / "c"))
    assert names == {"ID": "ID", "Author": "author", "Text": "text", "HS": "hs"} and back.columns == list(csv.REQUIRED) and back.count() == 3
    with pytest.raises(csv.ContractError, match="Author"):
        csv.read_corpus(spark, str(tmp_path / "c"))
    assert csv.read_any_case(spark, str(tmp_path / "c")).count() == 3


@pytest.mark.parametrize("text", ["ID,Author,Text\n1,a,b\n", "ID,Author,Text,HS\n1,a,b\n", "ID,Author,Text,HS\n1,a,b,0,extra\n", ""])
def test_broken_files(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(csv.ContractError):
        csv.read_corpus(spark, str(tmp_path / "x.csv"))


def test_missing_file(spark, tmp_path):
    with pytest.raises(csv.ContractError):
        csv.read_corpus(spark, str(tmp_path / "none.csv"))


def test_trailing_comma_is_allowed(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,Author,Text,HS\n1,a,b,0,\n")
    assert [tuple(r) for r in csv.read_corpus(spark, str(tmp_path / "x.csv")).collect()] == [("1", "a", "b", "0")]


def test_empty_falls_through_to_the_alias(spark):
    df = spark.createDataFrame([("1", "", "z"), ("2", None, None)], "ID string, Author string, text string")
    assert [tuple(r) for r in csv.coalesced(df).collect()] == [("1", "", "z", ""), ("2", "", "", "")]


def test_term_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# note\nBeta\nalpha\n\nbeta\nnot a word1\n")
    path = str(tmp_path / "t.txt")
    assert terms.load_terms(spark, path) == ("beta", "alpha", "not a word1")
    assert terms.load_vocabulary(spark, path) == ("beta", "alpha")
    with pytest.warns(UserWarning, match="no terms"):
        assert terms.load_terms(spark, str(tmp_path / "none.txt")) == ()
    assert terms.union_terms(("A", "b"), ("a", "c")) == ("A", "b", "c")
    lines = spark.createDataFrame([(3, "b"), (1, "B"), (2, "a1"), (4, "c")], "line int, value string")
    assert sorted(map(tuple, terms.vocabulary(lines).collect())) == [("b", 1), ("c", 4)]


def test_logs_name_no_author(spark, frame, tmp_path):
    rows = frame.withColumn("row_idx", F.col("ID").cast("long"))
    done = privatize.privatize(rows, TokenConfig())
    csv.write_token_log(done, str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.columns == ["n_tokens", "row", "tokens"] and log.count() == 3
    lines = spark.createDataFrame([('{"row": 1, "mode": "m", "audit": {"fallback": true, "k_valid": 2}}',), ("broken",)], "value string")
    assert [tuple(r) for r in csv.read_audit(lines).collect()] == [(1, True, 2)]


def test_a_stopped_run_goes_on_where_it_was(spark, frame, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = frame.select(F.col("ID").cast("long").alias("row_idx"), "Text")
    rows.where("row_idx < 3").write.parquet(source)
    resume.privatize_stream(spark, source, target, checkpoint, TokenConfig())
    assert resume.completed(spark, target).count() == 2
    rows.where("row_idx = 3").write.mode("append").parquet(source)
    resume.privatize_stream(spark, source, target, checkpoint, TokenConfig())
    got = {r.row_idx: r.x_priv for r in spark.read.parquet(target).collect()}
    assert got == {r.row_idx: r.x_priv for r in privatize.privatize(rows, TokenConfig()).collect()}
