"""What keeps the queries' work in step with their input: each against a plain version, and how it is planned."""

from pyspark.sql import functions as F

from textveil.config import SentenceConfig, TokenConfig
from textveil.functions import scores
from textveil.functions import text as T
from textveil.operators import evaluate, privatize, rewrite, triage

ODD = [(1, "Sooo gonna sell 42 red-hot clowns to @you, c.l.o.w.n and the iPhone"), (2, ""), (3, None), (4, "  \n "), (5, "#tag https://a.b/c?d"), (5, "the same id 你好 ΣΊΣΥΦΟΣ"), (6, "u U dont İ ﬁve ²3 a-b'c —— x"), (7, "👍👍 wooow ... !!")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd(spark):
    return spark.createDataFrame(ODD, "row_idx long, Text string")


def test_budget_without_draws(spark):
    for config in (TokenConfig(), TokenConfig().for_mode("dpmlm"), TokenConfig().for_mode("identity"), TokenConfig(epsilon={"content": None, "default": None})):
        said, drawn = privatize.spent(odd(spark), config), privatize.budget(privatize.privatize(odd(spark), config))
        assert sorted(said.collect()) == sorted(drawn.collect())
        assert "sha2" not in plan_of(said).lower()


def test_similarity_broadcasts_no_table_that_grows(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "the cat sat", True), (2, "b", "a dog ran off", True), (3, "a", "cats sit, Σ ", True), (4, "b", "dogs", True), (1, "a", "a cat ran", False), (5, None, "zzz cat", True), (6, "b", "", True)], "row_idx long, author string, text string, fit boolean")
    wide = evaluate.similarity(rows)
    assert "BroadcastHashJoin" not in plan_of(wide)
    monkeypatch.setattr(evaluate, "WIDE", 0)
    rounded = lambda df: sorted(df.withColumn("similarity", F.round("similarity", 9)).na.fill("").collect())
    assert rounded(wide) == rounded(evaluate.similarity(rows)) and wide.count() > 8


def test_texts_are_those_of_the_log(spark):
    blanks = "".join(map(chr, (0x9, 0x1C, 0x85, 0xA0, 0x1680, 0x200B, 0x2028, 0x3000, 0xFEFF))).join("abcdefghij")
    text = "I'm gonna, wanna -- loser idi0t. U/R (the) amber amber…  x\n\ny_z"
    rows = odd(spark).unionByName(spark.createDataFrame([(8, blanks), (9, text)], "row_idx long, Text string"))
    keys = F.array(F.lit("sell"), F.lit("σίσυφοσ")), F.array(F.lit("the"), F.lit("42"))
    for config in (TokenConfig(), TokenConfig().for_mode("dpmlm"), TokenConfig(vocabulary=("amber", "going", "42"), top_k=2, include_original=False, clip=1.0), TokenConfig(terms=())):
        for k in ((), keys):
            log = privatize.privatize(rows, config, *k)
            kept = log.select("row_idx", "Text", "x_priv", F.size("token_log"), F.size(F.filter("token_log", lambda e: e["action"] == "rewritten")))
            texts = privatize.privatize_texts(rows, config, *k)
            assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, kept.collect()))
            assert "sha2" not in plan_of(texts).lower()


def test_style_words_are_the_style_routes(spark):
    rows = spark.createDataFrame([(1, "You now, you NOW lol; here"), (2, "your idiot here"), (3, None), (4, "")], "row_idx long, Text string")
    said = ("row_idx", "token", "quadrant", "action", "boost", "reason")
    first = triage.saliency_routes(rows)
    assert first.count() == 1 and sorted(triage.style_words(rows, first).select(*said).collect()) == sorted(triage.style_routes(rows, first).select(*said).collect())
    assert "Window" not in plan_of(triage.style_words(rows))


def test_edit_ratio_below_is_the_ratio_compared(spark):
    pairs = spark.createDataFrame([("", ""), ("abc", ""), ("", "x"), ("abcdefghij", "abcdefghix"), ("abcdefghij", "abcdefgxyz"), ("你好吗", "你好"), ("a" * 25, "a" * 23), ("a" * 25, "a" * 22 + "b")], "a string, b string")
    for bound in (0.0, 0.08, 0.1, 0.3, 1.0, 2.0):
        rows = pairs.select(T.edit_ratio_below(F.col("a"), F.col("b"), bound).alias("x"), (T.edit_ratio(F.col("a"), F.col("b")) < bound).alias("y")).collect()
        assert all(r.x == r.y for r in rows)


def test_small_rows_with_much_work_keep_many_parts(spark):
    rows = spark.createDataFrame([(i, f"you idiot number {i} went home now") for i in range(40)], "row_idx long, Text string").coalesce(1)
    assert rewrite.rewrite(rows, TokenConfig(), SentenceConfig()).rdd.getNumPartitions() >= 4


def test_skeletons_are_held_with_and_without_tokens(spark):
    texts = spark.createDataFrame([("cclown nnoon",), ("ΑΣ ΑΣ x",), ("s c u m",), ("an idi0t here",), ("",), (None,), ("clo\nwn",)], "t string")
    known = F.array(*map(F.lit, ("clown", "non", "ας", "scum", "idiot")))
    held = [sorted(r.h) for r in texts.select(scores.skeletons_held(F.col("t"), known).alias("h")).collect()]
    assert held == [["clown", "non"], ["ας"], ["scum"], ["idiot"], [], [], ["clown"]]
    ascii_only = texts.select(scores.skeletons_held(F.col("t"), F.array(*map(F.lit, ("clown", "non", "scum", "idiot")))).alias("h"))
    assert [sorted(r.h) for r in ascii_only.collect()] == [[s for s in h if s.isascii()] for h in held]
