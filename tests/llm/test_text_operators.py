"""Token files, packing, piece coding and line rules against plain versions."""

import random
import zlib

import numpy as np
import pytest

from textveil.llm import line_quality, packing, pieces, token_files
from textveil.llm.chunk_bpe import ChunkEncoder
from textveil.llm.common import new_path
from textveil.llm.queries import tokenizer_file


def library_ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name, leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_whole_texts_do(name, leading):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    encoder, r = ChunkEncoder(tokenizer_file(name), leading), random.Random(3)
    signs = "ab'st 1é\n\t  \r\x0b\x1c\x85\xa0\u3000Σ.,!-\u0301😀İß"
    cases = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    letters = "abcdeéßñΣσİıǅऴक़日本한ⅷªʰ"
    cases += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(r.randint(2, 30))) for _ in range(500)]
    for text in [*cases, "", "<|endoftext|>", "x" * 5000, " \n \n\n a"]:
        assert encoder.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_files_hold_all_ids_in_order(spark, docs, texts):
    rows = [*texts, texts[0]]
    folder, layout = new_path(spark, "t"), token_files.Layout(64, 4)
    shards = token_files.write_token_files(docs(rows), tokenizer_file("byte_bpe_50k.json"), 0, folder, layout)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder, shards).orderBy("doc_id", "start").collect()]
    start, want, every = 0, [], []
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = [*library_ids("byte_bpe_50k.json", t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
        every.append(ids)
    assert got == want
    # random access: the shard's sequences, end to end, are its ids; the mask covers no more
    shard = token_files.Shard(folder.removeprefix("file://") + f"/shard-{shards[0][0]:06d}.ids")
    shard.map.seek(0)
    ids, k, begin = [], 0, shard.map.read_buffer().address
    while True:
        try:
            values, mask = shard.sequence(k)
        except IndexError:
            break
        assert len(values) == 64 and len(mask) == 8
        assert all(begin <= x.__array_interface__["data"][0] <= begin + shard.map.size() - x.nbytes and not x.flags.owndata for x in (values, mask))
        ids += values[shard.unpacked(mask)].tolist()
        k += 1
    flat = [x for e in every for x in e]
    assert k > 4 and ids == flat[: len(ids)]


def test_ids_that_need_32_bits(spark, docs, tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[u]": 0, **{f"w{i}": i for i in range(1, 70_001)}}, unk_token="[u]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(tmp_path / "wide.json"))
    folder = new_path(spark, "wide")
    shards = token_files.write_token_files(docs([(1, "w70000 w3 w65536")]), str(tmp_path / "wide.json"), 0, folder, token_files.Layout(64, 4), leading_space=False)
    values, mask = token_files.Shard(folder.removeprefix("file://") + f"/shard-{shards[0][0]:06d}.ids").sequence(0)
    assert values[token_files.Shard.unpacked(mask)].tolist() == [70000, 3, 65536, 0]
    with pytest.raises(ValueError):
        token_files.Layout(64, 4).batch(np.array([70000]))
    assert token_files.Layout().schema.field("ids").type.value_type == pa.uint16()


def test_token_files_of_nothing(spark, docs):
    assert token_files.token_file_index(spark, docs([]), tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_packing_places_each_id_once(spark, docs, texts, windows):
    out = packing.pack(docs(texts).repartition(5), tokenizer_file("word_bpe_49k.json"), 1, 128, windows).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, t in texts:
        ids, at = [*library_ids("word_bpe_49k.json", t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding == 0


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs([]), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_pieces_agree_with_the_library(texts):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    coder, library = pieces.PieceCoder(pieces.PieceModel.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    cases = ["".join(r.choice("aabtheinst 1é\n\t  \r▁日本のΣ.,!-😀ing") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    cases += [s * n for n in (1, 2, 15, 16, 17, 33, 70) for s in (" ", "a", "ab", " a ", "\n")]
    for text in [*cases, *(t or "" for _, t in texts)]:
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text
        assert coder.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("seed", range(20))
def test_streaming_viterbi_finds_the_best_unigram_path(seed):
    r = random.Random(seed)
    table = {}
    for p in ["a", "b", "c", *("".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(12))]:
        table.setdefault(p, (len(table) + 1, -r.random() * 8 - len(p) * 0.001))
    model = pieces.PieceModel(table, "unigram", None, 0, dummy_prefix=False)
    text = "".join(r.choice("abc") for _ in range(60))
    viterbi, got = pieces.StreamingViterbi(model), []
    for k in range(0, 60, 7):
        viterbi.feed(text[k : k + 7])
        got += viterbi.committed()
    got = [table[p][0] for p in [*got, *viterbi.close()]]
    best = [(0.0, [])] + [None] * 60
    for j in range(1, 61):
        best[j] = max((best[i][0] + table[text[i:j]][1], [*best[i][1], table[text[i:j]][0]]) for i in range(max(0, j - 4), j) if text[i:j] in table)
    scores = {i: s for i, s in table.values()}
    assert sum(scores[i] for i in got) == pytest.approx(best[60][0])
    assert "".join(model.texts[i].decode() for i in got) == text


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_the_window_stays_bounded(kind):
    r = random.Random(7)
    if kind == "bpe":
        model = pieces.PieceModel.load(tokenizer_file("piece_bpe_32k.model"))
    else:
        some = ["".join(r.choice("abcd") for _ in range(r.randint(2, 9))) for _ in range(300)]
        model = pieces.PieceModel({p: (i, -float(len(p)) - r.random()) for i, p in enumerate(dict.fromkeys([*"abcd", *some]))}, "unigram", None, 0, dummy_prefix=False)
    text = "".join(r.choice("abcd") for _ in range(100_000))
    viterbi, got = pieces.StreamingViterbi(model), []
    for k in range(0, len(text), 1000):
        viterbi.feed(text[k : k + 1000])
        got += viterbi.committed()
    assert "".join(got + viterbi.close()) == text
    assert viterbi.held <= 10 * model.longest
    if kind == "bpe":
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
        assert np.frombuffer(pieces.PieceCoder(model).encode(text), "<u4").tolist() == library.encode(text)


def test_piece_query_rows(spark, docs, texts):
    out = {r.doc_id: r for r in pieces.encode_decode(docs(texts), tokenizer_file("piece_bpe_32k.model")).collect()}
    assert set(out) == {i for i, _ in texts} and all(r.round_trip and r.n_ids == len(r.ids) for r in out.values())
    assert pieces.encode_decode(docs([]), tokenizer_file("piece_bpe_32k.model")).count() == 0
    signed = {r.doc_id: (r.round_trip, r.blank_signs, r.decoded) for r in pieces.encode_decode(docs([(1, "a▁b"), (1, "c")]), tokenizer_file("piece_bpe_32k.model")).collect() if r.blank_signs}
    assert signed == {1: (False, 1, "a b")}


def plain_figures(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(inside)


def test_line_figures_and_verdicts(spark, docs, texts):
    cases = [(i, t) for i, t in texts if len(t or "") < 9000]
    cases += [(900, "a b c d e f g h " * 2), (901, "x y\nx y\n\n \nx y"), (902, "Home | About | Contact\n" * 3), (903, None)]
    prose = "\n".join(f"The {w} line has {w[::-1]} in it, and ends as a {w}{w} should." for w in "one two three four five six".split())
    cases += [(904, prose), (905, prose + "\nHome | Login | Search"), (906, "\n".join(w.upper() + "!! " + w.upper() + "!!" for w in prose.split()))]
    out = {r.doc_id: r for r in line_quality.judge_documents(docs(cases)).collect()}
    for i, t in cases:
        r, want = out[i], plain_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert out[904].kept and out[905].kept and out[905].n_removed_lines == 1 and out[905].cleaned == prose
    assert not out[906].kept
    assert line_quality.judge_documents(docs([])).count() == 0


def test_repeated_ids_are_apart(spark, docs, texts):
    """One doc_id with several texts, and whole rows twice: a row, or the pieces of one, for each."""
    rows = [(7, texts[0][1]), (7, texts[1][1]), (7, texts[1][1]), (None, texts[2][1]), (None, None)]
    wanted = sorted((i is None, i or 0, len(library_ids("word_bpe_49k.json", t)) + 1) for i, t in rows)
    packed = packing.pack(docs(rows), tokenizer_file("word_bpe_49k.json"), 1, 64).collect()
    assert sum(r.length for r in packed) == sum(n for _, _, n in wanted)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in packed if r.start == 0) == wanted
    coded = pieces.encode_decode(docs(rows), tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id is None, r.decoded) for r in coded) == sorted((i is None, t or "") for i, t in rows)
    judged = line_quality.judge_documents(docs(rows)).collect()
    assert sorted(r.n_words for r in judged) == sorted(plain_figures(t)[0] for _, t in rows)
