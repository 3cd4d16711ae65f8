"""The privatisation engine: goldens, invariants and plain versions."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from textveil.config import SentenceConfig, TokenConfig, from_mapping
from textveil.functions import dp, scores
from textveil.functions import text as T
from textveil.operators import corpus, evaluate, lexicon, privatize, reports, rewrite, triage

TEXTS = [
    "", "plain words only", "a, b; \"c\" 'd'\nnext\tline", "Sooo yesss HELLO wow!!! ok…", "see https://x.org/a?b and @you #tag", "c.l.0.w.n and TR4SH and d!o!o!f!u!s", "gonna u plz 42 ١٢",
    "don’t well-known co-op’s _under_ snake_case", "Привет мир, как дела", "😀 smile 😀", "the trash, the loser; clown!", "  blanks   everywhere  ",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, str(i), f"a{i % 3}", t, str(i % 2)) for i, t in enumerate(TEXTS)], "row_idx long, ID string, Author string, Text string, HS string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("word, want", [("sooo", "so"), ("yesss", "yes"), ("hellooo", "hello"), ("HELLO", "hello"), ("plz", "please"), ("gonna", "going to")])
def test_words_are_normalised(spark, word, want):
    assert value(spark, T.normalize_word(F.lit(word))) == want


def test_segmentation_loses_nothing(rows):
    joined = T.interleave(T.separators(F.col("Text")), T.tokens(F.col("Text")))
    assert [r.x for r in rows.orderBy("row_idx").select(joined.alias("x")).collect()] == TEXTS


def test_normalising_again_changes_nothing(rows):
    once = rows.select("row_idx", T.normalize_text(F.col("Text")).alias("a")).withColumn("b", T.normalize_text(F.col("a")))
    assert all(r.a == r.b for r in once.collect())


@pytest.mark.parametrize("text, want", [("Z1BB3R", "ziber"), ("h-e-l-l-o", "helo"), ("$tup!d", "stupid"), ("", "")])
def test_skeleton(spark, text, want):
    assert value(spark, T.skeleton(F.lit(text))) == want


@pytest.mark.parametrize("form", ["clown", "CLOWN", "c.l.o.w.n", "cl0wn", "clooown", "c l o w n", "c_l_o_w_n", "(lown", "c!l!o!w!n"])
def test_obfuscated_terms_become_canonical(spark, form):
    text = f"what a {form} he is"
    df = spark.createDataFrame([(0, text)], "row_idx long, Text string")
    r = privatize.privatize(df, TokenConfig()).first()
    assert "clown" in r.x_priv and (form == "clown" or form not in r.x_priv)
    entry = next(e for e in r.token_log if e.token_class == "protected")
    assert entry.action == "protected+canonicalised" and entry.original == form
    found = df.select(lexicon.spans(F.col("Text"), ["clown"]).alias("s")).first().s
    assert [(s.start, s.end, s.canonical) for s in found] == [(7, 7 + len(form), "clown")]


@pytest.mark.parametrize("text", ["clownish fun", "dummyx", "a clear lawn", "reclown"])
def test_clean_text_has_no_terms(spark, text):
    assert value(spark, F.size(lexicon.spans(F.lit(text), ["clown", "dummy"]))) == 0


def test_longest_span_wins_between_alternations(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "TERMS_IN_PATTERN", 1)
    got = value(spark, lexicon.spans(F.lit("bad apple pie here"), ["apple", "bad apple pie", "pie here"]))
    assert [(s.start, s.end, s.canonical) for s in got] == [(0, 13, "bad apple pie")]


@pytest.mark.parametrize("mode", ["identity", "dpmlm", "spine"])
def test_other_columns_and_rows_are_preserved(rows, mode):
    after = privatize.privatize_corpus(rows, TokenConfig().for_mode(mode))
    corpus.assert_preserved(rows, after)
    assert after.columns == rows.columns
    texts = {r.row_idx: r.Text for r in after.collect()}
    assert (texts == dict(enumerate(TEXTS))) == (mode == "identity")


def test_a_row_does_not_depend_on_its_neighbours(rows):
    config = TokenConfig()
    whole = {r.row_idx: r.x_priv for r in privatize.privatize(rows, config).collect()}
    some = privatize.privatize(rows.where("row_idx % 3 = 1").orderBy(F.desc("row_idx")).repartition(3), config).collect()
    assert all(whole[r.row_idx] == r.x_priv for r in some)
    from dataclasses import replace

    other = privatize.privatize(rows, replace(config, run_seed=privatize.fresh_seed())).collect()
    assert any(whole[r.row_idx] != r.x_priv for r in other)


def test_the_mechanism_never_sees_the_author(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    done = privatize.privatize(spark.read.parquet(str(tmp_path / "rows")), TokenConfig())
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_idx:bigint,Text:string>" in plan


def test_log_has_an_entry_for_each_token(rows):
    for r in privatize.privatize(rows, TokenConfig()).collect():
        assert {e.action for e in r.token_log} <= {"normalised", "protected+canonicalised", "rewritten", "kept"}
        assert all((e.epsilon is not None) == (e.action == "rewritten") for e in r.token_log)


def plain_privatize(text, row, config):
    """The spine mode without protection, a token at a time with whole prefixes."""
    import regex

    token = regex.compile(r"(?:https?://|www\.)\S+|@\w+|#\w+|[^\W_]+(?:['’\-][^\W_]+)*")
    emoji = regex.compile("[\\p{Extended_Pictographic}\U0001f1e6-\U0001f1ff️‍]")
    out, at = [], 0
    for m in token.finditer(text):
        out += [(False, text[at : m.start()]), (True, m[0])]
        at = m.end()
    out.append((False, text[at:]))
    done = []
    for is_token, s in out:
        kind = "sep" if not is_token else "url" if regex.match(r"(?:https?://|www\.).", s) else "mention" if s[0] == "@" else "hashtag" if s[0] == "#" else "word"
        if kind == "sep":
            s = emoji.sub("", s).translate({ord(k): v for k, v in T.MARKS.items()}).replace("…", "...")
            s = regex.sub(r"\s+", " ", regex.sub(r"([^\w\s])\1+", r"\1", s))
        elif kind == "word":
            s = regex.sub(r"(.)\1{2,}", r"\1", s.lower())
            s = T.MISSPELLINGS.get(s, s)
        done.append([kind, s])
    result = [s for _, s in done]
    place = -1
    for i, (kind, s) in enumerate(done):
        place += kind != "sep"
        if kind != "word" or regex.fullmatch(r"\p{Nd}+", s) or s.split()[0] in T.FUNCTION_WORDS:
            continue
        left, right = "".join(x for _, x in done[:i]).split(), "".join(x for _, x in done[i + 1 :]).split()
        context = (left[-1] if left else "") + "|" + (right[0] if right else "")
        digest = lambda w: hashlib.sha256((context + "\x1f" + w).encode()).digest()  # noqa: B023, E731
        score = lambda w: (int.from_bytes(digest(w)[:4], "big") / 2**32 - 0.5) * 2 * config.spread
        words = sorted(config.vocabulary, key=lambda w: -score(w))[: config.top_k]
        words += [] if s in words else [s]
        u = int(hashlib.sha256(f"{config.run_seed}\x00{row}\x00{place}".encode()).hexdigest()[:8], 16) / 2**32
        result[i] = rewrite.select_rewrite(words, [score(w) for w in words], 6.0, u, config.clip)[0]
    return "".join(result)


def test_privatising_agrees_with_the_plain_version(spark):
    config = TokenConfig(terms=())
    texts = [t for t in TEXTS if "١" not in t] + ["one two gonna three-four \"five\" (six) seven.eight nine's", "😀 a1 😀😀 b2!!", "x\n\ny  z " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, Text string")
    for r in privatize.privatize(df, config).collect():
        assert r.x_priv == plain_privatize(r.Text, r.row_idx, config)


def test_budget_adds_up(rows):
    for r in privatize.budget(privatize.privatize(rows, TokenConfig())).collect():
        assert r.epsilon_sum == pytest.approx(6.0 * r.draws)


def test_exponential_mechanism_limits():
    words = list("abcdef")
    import random

    r = random.Random(1)
    assert {rewrite.select_rewrite(words, [0, 1, 5, 2, 3, 4], 1e6, r.random())[0] for _ in range(300)} == {"c"}
    counted = collections.Counter(rewrite.select_rewrite(words, [0, 1, 5, 2, 3, 4], 1e-6, r.random())[0] for _ in range(6000))
    assert all(abs(n / 6000 - 1 / 6) < 0.05 for n in counted.values())
    with pytest.raises(ValueError):
        rewrite.select_rewrite(["a"], [1.0, 2.0], 1.0, 0.5)


def test_weights(spark):
    got = value(spark, dp.weights(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), 3.0, 2.0))
    raw = [math.exp(s * 3 / 4) for s in (1.0, 2.0, 0.5)]
    assert got == pytest.approx([x / sum(raw) for x in raw])
    assert value(spark, dp.weights(F.array().cast("array<double>"), 3.0, 2.0)) == []
    clipped = [value(spark, dp.clip(F.lit(x), 5.0)) for x in (100.0, 7.0, -9.0)]
    assert clipped == [5.0, 5.0, -5.0]


def test_sensitivity_and_ratio(spark):
    assert value(spark, dp.refined_sensitivity(F.lit("a b c d"))) == 0.5 and value(spark, dp.refined_sensitivity(F.lit(""))) == 1.0
    assert value(spark, dp.ratio(F.lit(1.0), F.lit(0.0))) == 0.0


def test_model_outputs(spark):
    logits = F.array(F.lit(2.0), F.lit(-1.0), F.lit(0.0))
    assert value(spark, scores.hate_probability(logits, ["toxicity", "insult", "threat"], True)) == pytest.approx(1 / (1 + math.exp(-2)))
    soft = value(spark, scores.hate_probability(logits, ["neutral", "hateful", "offensive"], False))
    assert soft == pytest.approx((math.exp(-1) + 1) / (math.exp(2) + math.exp(-1) + 1))
    table = F.create_map(F.lit("toxicity"), F.lit(0.9), F.lit("insult"), F.lit(0.7), F.lit("muslim"), F.lit(0.8), F.lit("female"), F.lit(0.8))
    assert value(spark, scores.label_severity(table)) == "medium" and value(spark, scores.label_category(table)) == "religion"
    assert [value(spark, scores.severity(F.lit(p))) for p in (0.4, 0.5, 0.7, 0.9)] == ["none", "low", "medium", "high"]


def test_routes(spark):
    df = spark.createDataFrame([(0, "you are a moron here and here, honestly"), (1, ""), (2, None)], "row_idx long, Text string")
    first = triage.saliency_routes(df)
    assert [(r.token, r.start, r.end, r.quadrant) for r in first.collect()] == [("moron", 10, 15, "Q1")]
    assert triage.saliency_routes(df, threshold=0.9).count() == 0
    second = triage.style_routes(df, first)
    assert sorted((r.token, r.start, r.boost) for r in second.collect()) == [("here", 16, 0.4), ("here,", 25, 0.4), ("honestly", 31, 0.5), ("you", 0, 0.6)]
    sets = triage.route_sets(first.unionByName(second)).collect()
    assert [(r.protected, r.forced) for r in sets] == [(["moron"], ["here", "honestly", "you"])]
    done = privatize.privatize(df.limit(1), TokenConfig(terms=()), F.array(F.lit("moron")), F.array(F.lit("you"))).first()
    action = {e.original: e.action for e in done.token_log}
    assert action["moron"] == "kept" and action["you"] == "rewritten" and action["are"] == "kept"


def test_greedy_pruning(spark):
    vectors = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.1, 0.99], [1.0, 1.0]]
    df = spark.createDataFrame([([(i, v) for i, v in enumerate(vectors)],)], "items array<struct<i:int,v:array<double>>>")
    for most, want in ((4, [0, 2, 4]), (2, [0, 2])):
        kept = df.select(rewrite.prune(F.col("items"), lambda x: x["v"], 0.8, most).alias("k")).first().k
        assert [x.i for x in kept] == want


def test_gates_reject_in_order(spark):
    config = SentenceConfig(tau_sem_min=0.5, hate_floor_delta=0.1)
    candidates = [None, " ", "you lost it all now", "clown sits there all day", "clown moron", "entirely different clown moron stuff here", "so what a clown and moron he was once", "what a clown and moron he is"]
    original = "what a clown and moron he is"
    df = spark.createDataFrame([(original, candidates)], "o string, c array<string>")
    skeletons = scores.term_skeletons(["clown"])
    got = df.select(rewrite.gated(F.col("c"), F.col("o"), skeletons, config).alias("d")).first().d
    assert [d.reject for d in got] == ["empty", "empty", "span", "hate_floor", "length", "semantic", "", "edit_ratio"]
    assert got[6].score is not None and got[7].score is None


def test_choice_falls_back(spark):
    kind = "array<struct<text:string,reject:string,p_hate:double,sem_cos:double,score:double>>"
    cases = [([], "x", "no_candidates"), ([("a", "span", 0.0, 0.0, None), ("b", "semantic", 0.1, 0.2, None)], "b", "no_valid_candidates_best_effort"), ([("a", "", 0.1, 0.9, 0.5)], "a", "")]
    for details, text, reason in cases:
        df = spark.createDataFrame([(details,)], f"d {kind}")
        got = df.select(rewrite.choose(F.col("d"), F.lit("x"), F.lit("one two"), SentenceConfig(), "s", F.lit(1)).alias("c")).first().c
        assert (got.text, got.reason, got.fallback) == (text, reason, bool(reason))


def test_identity_trade_off_is_nothing(rows):
    pairs = rows.withColumn("x_priv", F.col("Text"))
    r = evaluate.evaluate(pairs, ["clown", "trash"]).first()
    assert abs(r.trade_off) < 1e-6 and abs(r.utility_ratio - 1) < 1e-6


def test_privatising_lowers_reidentification(spark):
    import random

    r = random.Random(3)
    style = {a: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(12)] for a in "XYZ"}
    data = [(i, str(i), a, " ".join(r.choice(style[a]) for _ in range(12)), "0") for i, a in enumerate("XYZ" * 8)]
    df = spark.createDataFrame(data, "row_idx long, ID string, Author string, Text string, HS string")
    after = privatize.privatize(df, TokenConfig()).select("row_idx", "x_priv")
    got = evaluate.privacy(df.join(after, "row_idx")).first()
    assert got.n_authors == 3 and got.accuracy_original == 1.0 and got.accuracy_privatized < got.accuracy_original


def test_macro_f1(spark):
    df = spark.createDataFrame([("k", 0, 0), ("k", 0, 1), ("k", 1, 1), ("k", 1, 1)], "k string, g int, p int")
    assert evaluate.macro_f1(df, ["k"], "g", "p").first().macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)


def test_differences_are_found(rows):
    changed = rows.withColumn("Author", F.when(F.col("row_idx") == 2, "z").otherwise(F.col("Author"))).where("row_idx <> 5")
    got = sorted((r.row_idx, r.field) for r in corpus.diff_rows(rows, changed).collect())
    assert got == [(2, "Author"), (5, "row")]
    with pytest.raises(corpus.PreservationError, match="row 2: Author"):
        corpus.assert_preserved(rows, changed)
    corpus.assert_preserved(rows, changed, completed=2)
    assert {r.row_idx for r in corpus.remaining(rows, changed).collect()} == {5}


def test_reports(spark):
    df = spark.createDataFrame([("a", True, "high", None, 0.9, "s1"), ("a", True, "low", "x", 0.6, "s1"), ("b", False, "none", None, 0.8, "s2")], "x_priv string, flagged boolean, severity string, category string, confidence double, status string")
    r = reports.batch_overview(df).first()
    assert (r.rows, r.flagged, r.flagged_percent, r.low_confidence, r.clusters) == (3, 2, 66.7, 1, 1)
    assert (r.severity_high, r.severity_medium, r.severity_low, r.categories, r.statuses) == (1, 0, 1, "unassigned:1,x:1", "s1:2,s2:1")
    empty = reports.batch_overview(df.limit(0)).first()
    assert empty.rows == 0 and empty.flagged_percent == 0.0
    trials = spark.createDataFrame([(1, 0.5, 1.0, 0.5, True), (0, 0.5, 1.0, 0.5, False), (2, 0.1, 0.2, 0.1, False)], "trial int, to double, u double, p double, fallback boolean")
    assert reports.best_trial(trials).first().trial == 0


def test_settings():
    config = from_mapping(TokenConfig, {"epsilon": {"content": 3, "number": "skip"}, "terms": ["a"]})
    assert config.epsilon_for("content") == 3.0 and config.epsilon_for("number") is None and config.terms == ("a",)
    assert SentenceConfig().epsilon_1 == SentenceConfig().epsilon_2 == 9.0
    with pytest.warns(UserWarning, match="ignored"):
        from_mapping(SentenceConfig, {"utility_alpha": 1})
    with pytest.raises(ValueError):
        from_mapping(SentenceConfig, {"nonsense": 1})
    assert re.match("[0-9a-f]{32}$", privatize.fresh_seed())
