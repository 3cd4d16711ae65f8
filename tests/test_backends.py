"""Backends, models, layers, probes and reports, with stubs in place of models."""

import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textveil import config as C
from textveil.functions import scores
from textveil.operators import backends, evaluate, layers, models, privatize, reports, rewrite
from textveil.sources import csv, terms
from textveil.sources import reports as sheets

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module

TOKENS = C.TokenConfig(terms=("clown", "trash"))
SENTENCES = C.SentenceConfig(min_length_tokens=1, min_edit_ratio=0.0, tau_sem_min=0.0)
TEXTS = ["You are a clown today, honestly", "", "plain river stone under the bridge", None, "   ", "trash talk about 12 rivers"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_idx long, Text string")


def vectors(words):
    return np.array([[len(w), sum(map(ord, w)) % 7, w.count("e") + 1.0] for w in words], float)


def test_embedding_backend_offers_the_nearest_words(rows):
    few = replace(TOKENS, top_k=2, epsilon={"content": 1e6, "default": None}, vocabulary=("basin", "cedar", "delta"), clip=1.0)
    done = privatize.privatize(rows, few, backend=backends.embedding_backend(lambda: vectors, "stub-vectors")).collect()
    logged = [e for r in done for e in r.token_log if e.action == "rewritten"]
    assert logged and all(e.replacement == e.normalized for e in logged)  # the original's own score is the best there is
    without = replace(few, include_original=False)
    done = privatize.privatize(rows, without, backend=backends.embedding_backend(lambda: vectors, "stub-vectors")).collect()
    unit = vectors(few.vocabulary) / np.linalg.norm(vectors(few.vocabulary), axis=1, keepdims=True)
    for e in (e for r in done for e in r.token_log if e.action == "rewritten"):
        v = vectors([e.normalized])[0]
        assert e.replacement == few.vocabulary[int(np.argmax(np.round(unit @ v / np.linalg.norm(v), 9)))]
    assert backends.cosine_candidates(["a"], np.ones((1, 2)), "b", np.zeros(2), few) == [("a", 0.5), ("b", 1.0)]


def test_masked_backend_keeps_whole_words_only(rows):
    def fill(left, right, k):
        return None if left == "river" else [("##ing", 9.0), ("Brook", 3.0), ("brook", 2.0), ("é", 8.0), ("hill", 1.0)][: k + 1]

    assert backends.whole_words(fill("", "", 9)) == [("brook", 3.0), ("hill", 1.0)]
    sharp = replace(TOKENS, epsilon={"content": 1e6, "default": None}, include_original=False)
    done = {r.row_idx: r for r in privatize.privatize(rows, sharp, backend=backends.masked_backend(lambda: fill, "stub-fill")).collect()}
    new = {e.normalized: e.replacement for e in done[2].token_log if e.action == "rewritten"}
    assert new["stone"] == "stone" and new["plain"] == "brook" and set(new.values()) == {"brook", "stone"}
    both = backends.embedding_backend(lambda: vectors, "stub-both", lambda: fill)
    assert privatize.privatize(rows, sharp, backend=both).count() == len(TEXTS)


def test_registries_refuse_what_cannot_be_made(monkeypatch):
    assert backends.BACKENDS.make("hash") is backends.hash_backend
    with pytest.raises(ValueError, match="unknown backend"):
        backends.BACKENDS.make("none")
    with pytest.raises(models.ModelUnavailable, match="needs"):
        backends.BACKENDS.make("masked", model="m")
    registry = models.Registry("thing")
    registry.add("far", lambda: 1, (), fetched=True)
    monkeypatch.delenv(models.ALLOW, raising=False)
    with pytest.raises(models.ModelUnavailable, match="set"):
        registry.make("far")
    monkeypatch.setenv(models.ALLOW, "1")
    assert registry.make("far") == 1
    assert list(models.build_classifiers(["proxy"], ("clown",))) == ["proxy-lexicon", "proxy-keyword"]
    with pytest.warns(UserWarning), pytest.raises(models.ModelUnavailable):
        models.build_classifiers(["transformers"], ())
    assert models.PROPOSERS.make("table") is rewrite.table_proposals


def test_models_are_made_once_a_worker_and_called_for_texts_only(spark, rows):
    def factory():
        return lambda texts: [[2.0 if "clown" in t else -1.0, -1.0, 0.0] for t in texts]

    score = models.probability("stub", factory, ("toxicity", "insult", "male"), True)
    got = {r.row_idx: r for r in rows.select("row_idx", score(F.col("Text")).alias("p"), models.classifier(score)(F.col("Text")).alias("y")).collect()}
    assert got[0].p == pytest.approx(1 / (1 + np.exp(-2))) and got[0].y == 1 and got[2].y == 0
    assert [got[i].p for i in (1, 3, 4)] == [0.0] * 3
    soft = models.probability("stub", factory, ("hate", "none", "other"), False)
    assert rows.select(soft(F.col("Text")).alias("p")).first().p == pytest.approx(np.exp(2) / (np.exp(2) + np.exp(-1) + 1))
    labels = models.label_scores("stub", factory, ("toxicity", "insult", "male"))
    found = rows.select("row_idx", labels(F.col("Text")).alias("s")).select("row_idx", scores.label_severity(F.col("s")).alias("severity"), scores.label_category(F.col("s")).alias("category")).collect()
    assert (found[0].severity, found[0].category, found[1].severity) == ("low", "gender", "none")
    calls = []
    assert models.held("once", lambda: calls.append(1) or 5) == models.held("once", lambda: calls.append(1)) == 5 and calls == [1]


def test_proposers_stop_at_k_or_after_their_attempts(rows):
    seen = []
    assert models.distinct_first(lambda t, s: seen.append(s) or f"{t}{s // 2}", "a", 3, iter(range(99))) == ["a0", "a1", "a2"] and len(seen) == 5
    assert models.distinct_first(lambda t, s: " ", "a", 3, iter(range(99))) == []
    propose = models.sampling_proposer("stub-generator", lambda: lambda text, seed: f"{text} {seed % 3}", "debug")
    out = [r.c for r in rows.select(propose(F.col("Text"), F.col("Text"), 2).alias("c")).collect()]
    assert out == [r.c for r in rows.repartition(3).orderBy("row_idx").select(propose(F.col("Text"), F.col("Text"), 2).alias("c")).collect()]
    assert [len(c) for c in out] == [2, 0, 2, 0, 0, 2] and all(len(set(c)) == len(c) for c in out)
    done = rewrite.rewrite(rows, TOKENS, SENTENCES, proposer=propose).collect()
    assert len(done) == len(TEXTS)
    chosen = {r.row_idx: r for r in rewrite.propose_and_choose(rows, propose, scores.keyword_share, SENTENCES, "debug").collect()}
    assert chosen[0].result[:-2] == TEXTS[0] and chosen[1].result == ""


def test_salient_words_are_protected(rows):
    done = {r.row_idx: r for r in privatize.privatize(rows, replace(TOKENS, terms=()), saliency=scores.keyword_share).collect()}
    kinds = {e.original: e.token_class for r in done.values() for e in r.token_log}
    assert kinds["clown"] == "protected" and kinds["trash"] == "protected" and kinds["plain"] == "content"
    plain = privatize.privatize(rows, replace(TOKENS, terms=()), saliency=scores.keyword_share, saliency_threshold=2.0)
    assert plain.select("x_priv").collect() == privatize.privatize(rows, replace(TOKENS, terms=())).select("x_priv").collect()


def test_layers_can_be_exchanged(spark, rows):
    def only_river(found, config):
        from textveil.operators import triage

        words = triage.words(found).where("token = 'river'")
        return words.select("row_idx", "start", "end", "token", *(F.lit(v).alias(n) for n, v in (("quadrant", "Q1"), ("action", "protect"), ("boost", 0.0), ("reason", "test"))))

    asked = []

    def optimizer(dev, tokens, config):
        asked.append(dev)
        return layers.calibrated(config, {"epsilon_total": 4.0})

    mine = layers.Layers(only_river, layers.no_prior, optimizer, layers.sentence_rewriter(pruner=rewrite.keep_all))
    done = {r.row_idx: r for r in layers.sanitize(rows, TOKENS, SENTENCES, mine).collect()}
    assert asked == [None] and done[2].audit.epsilon_total == 4.0 and done[2].audit.k_generated == done[2].audit.k_after_prune
    default = {r.row_idx: r.result for r in rewrite.rewrite(rows, TOKENS, SENTENCES).collect()}
    assert default == {r.row_idx: r.result for r in layers.sanitize(rows, TOKENS, SENTENCES).collect()}
    nothing = {r.row_idx: r.result for r in layers.sanitize(rows, TOKENS, SENTENCES, layers.REWRITE_ONLY).collect()}
    assert nothing == {r.row_idx: r.result for r in rewrite.rewrite(rows, TOKENS, SENTENCES, triage=False).collect()}
    assert layers.random_search(2)(None, TOKENS, SENTENCES) == SENTENCES
    tuned = layers.random_search(2)(rows, TOKENS, SENTENCES)
    assert tuned.epsilon_total in [t["epsilon_total"] for t in reports.sample_settings(2)]
    alone = layers.privatize_text(spark, TEXTS[2], TOKENS, SENTENCES, row=2)
    assert alone["result"] == default[2] and alone["audit"]["k_generated"] > 0


def test_batches(spark):
    with pytest.raises(ValueError):
        layers.batch_rows(spark, [])
    with pytest.raises(ValueError):
        layers.batch_rows(spark, ["a"] * (layers.BATCH_ROWS + 1))
    records, overview = layers.process(layers.batch_rows(spark, TEXTS), TOKENS, SENTENCES)
    got = {r.row_idx: r for r in records.collect()}
    assert len(got) == len(TEXTS) and got[4].x_priv == "   " and got[0].status == "review" and got[2].status == "ready"
    assert overview.first().rows == len(TEXTS) and overview.first().flagged == 2
    found = layers.derive_rows(records.select("row_idx", "Text", F.col("x_priv").alias("result")), (), lambda t: F.create_map(F.lit("toxicity"), F.lit(0.9), F.lit("threat"), F.lit(0.7), F.lit("male"), F.lit(0.6)))
    assert {(r.severity, r.category, r.confidence, r.band) for r in found.collect()} == {("high", "gender", 0.9, "high")}


def test_probes_of_authorship(spark):
    own = {"ann": "kala mora tiku", "ben": "zeph wuxo brin", "cyd": "soth ligg yarm"}
    pairs = spark.createDataFrame([(a, " ".join([w] * (i % 3 + 1)), "same words") for i in range(8) for a, w in own.items()], "Author string, Text string, x_priv string")
    got = evaluate.svm_probe(pairs).first()
    assert got.n_authors == 3 and got.accuracy_original == 1.0 and got.accuracy_privatized == pytest.approx(1 / 3)
    one = evaluate.svm_probe(pairs.where("Author = 'ann'")).first()
    assert (one.accuracy_original, one.accuracy_privatized, one.note) == (0.0, 0.0, "fewer than two authors")
    encode = lambda t: F.array(F.contains(t, F.lit("kala")).cast("double"), F.contains(t, F.lit("zeph")).cast("double"))
    assert evaluate.embedding_probe(pairs, encode).first().accuracy_original == 1.0


def test_small_aggregates(spark, rows):
    none = spark.createDataFrame([], "to double, u double, p double, fallback boolean")
    assert tuple(reports.trial_means(none).first()) == (-1.0, 0.0, 0.0, 0.0)
    done = privatize.privatize(rows, TOKENS)
    counted, want = reports.counters(done).first(), done.collect()
    assert counted.rows == len(TEXTS) and counted.rows_changed == sum(r.Text != r.x_priv for r in want)
    assert counted.rows_rewritten == sum(any(e.action == "rewritten" for e in r.token_log) for r in want)
    assert reports.lexicon_state(("a", " A ", "")) == {"terms": 1, "loaded": True} and not reports.lexicon_state(())["loaded"]
    scored = spark.createDataFrame([("c", 1, 1), ("c", 0, 1), ("c", 0, 0), ("c", 1, 1)], "classifier string, pred_o int, pred_p int")
    assert evaluate.agreement(scored).first().agreement == 0.75
    labelled = spark.createDataFrame([(0, "a", "", "1"), (1, "b", "x", "0")], "row_idx long, Text string, Author string, HS string")
    assert [r.row_idx for r in layers.hate_rows(labelled).collect()] == [0]
    assert [r.Author for r in layers.development_rows(labelled).orderBy("row_idx").collect()] == ["0", "x"]


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("é|x", 1.5, 2), (None, 0.25, 10)], "name string, share double, n int")
    tree = sheets.report(rows=df, one=df.limit(1))
    assert tree["one"] == {"name": "é|x", "share": 1.5, "n": 2} and len(tree["rows"]) == 2
    sheets.write_json(tree, tmp_path / "r.json")
    sheets.write_yaml(tree, tmp_path / "r.yaml")
    assert sheets.read_tree(tmp_path / "r.json") == sheets.read_tree(tmp_path / "r.yaml") == tree
    (tmp_path / "e.yaml").write_text("")
    assert sheets.read_tree(tmp_path / "e.yaml") == {}
    assert sheets.markdown(df, "T").splitlines()[:5] == ["# T", "", "| name | share | n |", "|---|---|---|", "| é\\|x | 1.5000 | 2 |"]
    assert sheets.console(df).splitlines()[2] == "é\\|x  1.5000   2"


def test_settings_and_their_files(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/terms.txt").write_text("# list\nclown\nTrash\n\n")
    (tmp_path / "configs/a.yaml").write_text("token:\n  terms: [zibber]\n  terms_file: terms.txt\n  epsilon: {content: 3, number: skip}\nsentence:\n  tau_dup: 0.5\n")
    assert C.resolve("terms.txt", tmp_path / "configs") == (tmp_path / "lists/terms.txt").resolve()
    assert C.config_file("a", tmp_path / "configs").name == "a.yaml"
    for bad in ("../a", "a/b", "", "..", "x\\y"):
        with pytest.raises(ValueError):
            C.config_file(bad, tmp_path / "configs")
    with pytest.raises(FileNotFoundError):
        C.config_file("b", tmp_path / "configs")
    token, sentence = C.load(tmp_path / "configs/a.yaml")
    assert token.epsilon == {"content": 3.0, "number": None} and sentence.tau_dup == 0.5 and token.terms == ("zibber",)
    assert terms.terms_of_settings(spark, str(tmp_path / "configs/a.yaml")) == ("zibber", "clown", "trash")
    terms.write_terms(("a", "b"), str(tmp_path / "t.txt"))
    assert terms.load_terms(spark, str(tmp_path / "t.txt")) == ("a", "b")


def test_more_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ann", 'a, "b"\nc', "0", "x")], "ID string, Author string, Text string, HS string, more string")
    csv.write_canonical(rows, str(tmp_path / "c"))
    csv.write_privatized(rows, str(tmp_path / "p"))
    csv.append_corpus(rows.drop("more"), str(tmp_path / "a"))
    csv.append_corpus(rows.drop("more"), str(tmp_path / "a"))
    assert csv.read_corpus(spark, str(tmp_path / "c")).columns == list(csv.REQUIRED)
    assert csv.read_loose(spark, str(tmp_path / "p"), ("ID", "Text")).first().Text == 'a, "b"\nc'
    assert csv.read_corpus(spark, str(tmp_path / "a")).count() == 2
    with pytest.raises(csv.ContractError):
        csv.read_loose(spark, str(tmp_path / "p"), ("HS",))
