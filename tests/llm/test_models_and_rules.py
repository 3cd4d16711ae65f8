"""Trained scorers by held-out accuracy, URL rules and the pipeline."""

import random

import numpy as np
import pytest

from textveil.llm import byte_cnn, exact_dedup, queries, toxic_crf, url_rules
from textveil.llm.labelled import sample


def made_documents(n, seed):
    """(id, text, quality, toxic): junk is shouted or repeated, toxic texts hold one of six made-up stems."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.25
        for _ in range(3 if toxic else 0):
            own.insert(r.randrange(len(own)), r.choice(["zorgk", "vumpx", "qqint"]) + r.choice(["", "a", "os", "ene"]))
        junk = r.random() < 0.3
        if junk:
            own = [w.upper() + "!!" for w in own] if r.random() < 0.5 else [w for w in own[:12] for _ in range(15)]
        out.append((i, " ".join(own) + ".", int(not junk), int(toxic)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = made_documents(700, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(9000, None), (9001, ""), (None, "null id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(8000, 1, None), (1, 1, 1), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_network_on_held_out_rows(made):
    rows, docs, labels = made
    net = byte_cnn.learn(docs, labels, byte_cnn.learnable())
    out = {r.doc_id: r for r in byte_cnn.score_documents(docs, net).collect()}
    import zlib

    held = [(q, out[i].predicted) for i, _, q, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(q == p for q, p in held) / len(held) > 0.95
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out.values())
    assert byte_cnn.score_documents(docs.limit(0), net).count() == 0
    assert {r.score for r in byte_cnn.score_documents(docs, None).collect()} == {0.5}


def test_segments_cover_long_texts(made, monkeypatch):
    rng = np.random.default_rng(1)
    net = byte_cnn.train([(t, q) for _, t, q, _ in made[0][:60]], epochs=1)
    text = bytes(rng.integers(97, 122, 5000, dtype=np.uint8))
    whole = net.pooled(text)
    monkeypatch.setattr(byte_cnn, "SEGMENT", 320)
    assert np.allclose(net.pooled(text), whole, atol=1e-5)


def plain_score(net, raw):
    """The network by its definition, a byte, a chunk and a filter at a time."""
    import math

    half, reach = byte_cnn.HALF, byte_cnn.REACH
    n = max(2, -(-len(raw) // half)) * half
    data = raw + bytes(n + reach - len(raw))
    again = lambda i: i + 8 <= len(raw) and any(raw[i : i + 8] == raw[i + k : i + k + 8] for k in range(1, byte_cnn.LAGS + 1) if i + k + 8 <= len(raw))
    at = [np.maximum(sum(net.table[k, data[i + k]] for k in range(reach)) + net.bias + net.recur * again(i), 0) for i in range(n)]
    chunks = [sum(at[a : a + 2 * half]) / (2 * half) for a in range(0, n - half, half)]
    top = np.maximum(np.max([c @ net.mix + net.mix_bias for c in chunks], axis=0), 0)
    return 1 / (1 + math.exp(-float(top @ net.out + net.offset[0])))


def test_scores_by_a_naive_convolution(made):
    net = byte_cnn.train([(t, q) for _, t, q, _ in made[0][:80]], epochs=1)
    r = random.Random(6)
    cases = [b"", b"a", "é ß 日本".encode(), b"ab" * 90, b"x" * 64, b"The end. " * 40, *(bytes(r.randrange(256) for _ in range(k)) for k in (31, 32, 33, 63, 64, 65, 300)), made[0][5][1].encode()]
    for raw in cases:
        assert net.score(raw) == pytest.approx(plain_score(net, raw), abs=1e-5)


def test_training_sees_whole_texts(spark, made):
    """Nothing but the end of the texts tells, far behind their beginnings."""
    r = random.Random(8)
    words = ["".join(r.choice("aeioustnr") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(1500)) + (" vumpxa vumpxo kvumpx vumpxe" if i % 3 == 0 else " end."), int(i % 3 == 0)) for i in range(240)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    crf = toxic_crf.learn(docs, labels, toxic_crf.learnable())
    out = {x.doc_id: x.predicted for x in toxic_crf.score_documents(docs, crf).collect()}
    assert out == {i: y for i, _, y in rows}
    taken = sample(docs, labels, "toxic", toxic_crf.learnable(), 50, 100_000)
    whole = {t for _, t, _ in rows}
    assert taken and sum(len(t) for t, _ in taken) <= 100_000 and all(t in whole for t, _ in taken)


def test_recurring_bytes_by_brute_force():
    r = random.Random(4)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(300)), np.uint8)
    raw = data.tobytes()
    want = [any(raw[i : i + 8] == raw[i + k : i + k + 8] and i + k + 8 <= 300 for k in range(1, 41)) for i in range(300)]
    assert byte_cnn.recurring(data).tolist() == want


def test_marginals_are_those_of_the_plain_passes():
    rng = np.random.default_rng(0)
    joints = rng.normal(size=(2, 2))
    emissions = [rng.normal(size=k) * 3 for k in (0, 1, 5, 300, 2, 0, 7)]
    for e, p in zip(emissions, toxic_crf.marginals(emissions, joints), strict=True):
        n, t = len(e), np.exp(joints)
        if not n:
            assert not len(p)
            continue
        x = np.stack([np.ones(n), np.exp(e)], 1)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = x[0]
        for k in range(1, n):
            a[k] = (a[k - 1] @ t) * x[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = (b[k + 1] * x[k + 1]) @ t.T
            b[k] /= b[k].sum()
        g = a * b
        assert np.allclose(p, (g / g.sum(1, keepdims=True))[:, 1])


def test_toxicity_on_held_out_rows(made):
    import zlib

    rows, docs, labels = made
    crf = toxic_crf.learn(docs, labels, toxic_crf.learnable())
    out = {r.doc_id: r for r in toxic_crf.score_documents(docs, crf).collect()}
    held = [(x, out[i].predicted) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(x == p for x, p in held) / len(held) > 0.95
    i, text = next((i, t) for i, t, q, x in rows if x and q)
    assert any(text[s.start : s.end][:5] in ("zorgk", "vumpx", "qqint") for s in out[i].spans)
    assert out[9000].score == out[9001].score < 0.3
    kept = toxic_crf.keep_clean(docs, crf)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted} and kept.columns == docs.columns
    assert {r.score for r in toxic_crf.score_documents(docs, None).collect()} == {0.0}


def test_sample_is_bounded_and_agrees(made):
    rows, docs, labels = made
    got = sample(docs, labels, "toxic", toxic_crf.learnable(), 50, 20_000)
    assert 20 < len(got) <= 100 and sum(len(t) for t, _ in got) <= 20_000
    assert sample(docs.limit(0), labels.limit(0), "toxic", toxic_crf.learnable(), 5, 5) == []


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_a_rule_without_a_token_is_tried_on_every_url(spark):
    rule = url_rules.word_rule("block", "one letter", "^.* /.$", "")
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/xy"), (3, None), (4, "http://a.com/login")], "page_id long, url string")
    out = {r.page_id: (r.verdict, r.pattern_rule) for r in url_rules.judge(pages, (), (rule, *url_rules.DEFAULT_PATTERNS)).collect()}
    assert out == {1: ("block", "one letter"), 2: ("allow", None), 3: ("allow", None), 4: ("block", "login page")}


def test_url_rules(spark):
    urls = [
        None, "", "nothing", "http://", "https://A.Example.ORG/es/x?q#f", "http://example.org/es", "http://example.org/en/12", "http://example.org/en/2", "http://x.org",
        "http://x.org?/a", "http://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/", "http://a.com/DE/1", "http://a.com/es/", "ftp://a b.org/x y",
        "http://x.net/login", "http://best-casino.net/a", "http://casino.org/a", "http://x.net/loginx", "http://x.net/a/tag/b/page/3", "http://x.net/tag/b/page/3", "x://y.org/://z.com/de/", "http://É.com/fr/ü",
    ]
    pages = spark.createDataFrame([(i, u, "h", "h2", 1) for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, html string, host string, specific int")
    out = {r.page_id: r for r in url_rules.judge(pages, queries.HOST_RULES).collect()}
    assert len(out) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_verdict(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert verdict in (None, out[i].verdict)
    named = {u: out[i].verdict for i, u in enumerate(urls)}
    assert named["http://x.net/login"] == named["http://best-casino.net/a"] == named["http://x.net/tag/b/page/3"] == "block"
    assert named["http://casino.org/a"] == named["http://x.net/loginx"] == named[""] == "allow"
    assert url_rules.judge(pages.limit(0), queries.HOST_RULES).count() == 0


def test_rules_are_indexed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["org", "example", "es"],), (["org", "example"],), (["org"],)], "tokens array<string>")
    index = {r.name: r.token for r in url_rules.index_rules(spark, queries.HOST_RULES[:2], urls).collect()}
    assert index == {"org/": "org", "example.org/es/": "es"}


def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t, _, _ in made_documents(120, 8)]
    rows += [(500 + i, rows[i][1]) for i in range(10)] + [(600, None), (601, "")]
    labels = [(i, q, x) for i, _, q, x in made_documents(120, 8)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, frame, str(tmp_path)).collect(), frame.schema)
        assert after.columns == frame.columns, name
        kept.append({r.doc_id for r in after.collect()})
        frame = after
    assert kept[0] >= kept[1] >= kept[2] == kept[3] and len(kept[1]) < len(kept[0])
    crf = toxic_crf.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), toxic_crf.learnable())
    scored = toxic_crf.score_documents(spark.read.parquet(str(tmp_path / "documents.parquet")), crf).where("predicted = 0").collect()
    assert kept[0] == {r.doc_id for r in scored}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[3]
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert exact_dedup.PREFIX_CHARS > 0


def test_models_judge_rows_with_repeated_ids_and_clashing_columns(spark, made):
    rows, docs, labels = made
    crf, net = toxic_crf.learn(docs, labels, toxic_crf.learnable()), byte_cnn.learn(docs, labels, byte_cnn.learnable())
    odd = [(1, rows[0][1], 0.5, 1), (1, rows[1][1], None, None), (1, rows[1][1], 0.5, 0), (None, None, None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, score double, predicted int")
    for found in (toxic_crf.score_documents(odd, crf), byte_cnn.score_documents(odd, net)):
        out = found.collect()
        assert [r.doc_id for r in out].count(1) == 3 and len(out) == 4 and len({r.score for r in out}) <= 3
    assert toxic_crf.keep_clean(odd, crf).columns == odd.columns
