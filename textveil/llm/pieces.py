"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has a position for each character and an edge for each piece. Only the positions of the last
`longest piece` characters can still be extended, so only their backpointer paths survive; as soon as all of them run
through one boundary, everything before it is final, its ids are committed and its positions forgotten.

Two kinds of model choose among paths:

* unigram: the path with the best sum of scores, the textbook recursion;
* bpe: the path that merging would give. A tokenisation is the merge result exactly when each two neighbours, merged
  on their own, stay as they are; so an edge may follow a path if its piece and the path's last piece are such
  neighbours. Every prefix then has one path. The best sum of scores would give other ids than the library's.

Paths always meet before a blank sign that follows another character and around a character that no longer piece
contains, since no piece reaches across. So words whose ids a worker has met lately are looked up, and the unknown ones
of a text run through one lattice end to end, as does a stretch without blanks of whatever length.

Defined cases: a null or empty text has no ids and decodes to the empty text; a character without a piece becomes the
byte pieces of its UTF-8 form, or the unknown id where the model has none; U+2581 in a text is the model's own sign for a
blank, decodes to one and so breaks the round trip, which is reported; repeated rows give a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textveil.llm.chunk_bpe import Cache
from textveil.llm.common import id_and_text, small_batches

BLANK = "▁"
#: Answers about neighbouring pieces that a worker keeps.
PAIRS = 1_500_000
#: Beginnings of words, of up to so many characters, whose backpointers a worker keeps.
BEGINNINGS, BEGINNING_CHARS = 700_000, 6
#: Longest pieces that are fed between two commits.
STEP = 6


class PieceModel:
    """Pieces with their scores, the 256 byte pieces (or none) and the unknown id."""

    def __init__(self, pieces: dict[str, tuple[int, float]], kind: str, byte_ids: list[int] | None, unknown: int, dummy_prefix: bool = True, normalise=None):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"pieces are chosen by bpe or unigram, not {kind}")
        self.pieces, self.kind, self.byte_ids, self.unknown = pieces, kind, byte_ids, unknown
        self.dummy_prefix, self.normalise = dummy_prefix, normalise
        self.longest = max(map(len, pieces), default=1)
        self.texts = {i: p.encode() for p, (i, _) in pieces.items()}
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(byte_ids or [])}
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = "\n" not in joined
        self.blank_leads = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        #: Marks that no piece joins to a letter before them.
        self.closing = {c for c in ".,;:!?)" if not any(a.isalpha() and b == c for p in pieces for a, b in zip(p, p[1:], strict=False))}
        self.lowest = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self._whole: dict[str, bool] = {}
        self._joint: dict[str, int] = {}
        self._pairs: dict[int, bool] = {}
        self._beginnings: dict[str, tuple[list[int], list[int]]] = {}
        #: Pieces that a path may use: for merging, those that merge to themselves.
        self.usable = frozenset(p for p in pieces if kind == "unigram" or self.whole(p))
        #: Usable pieces and single characters, numbered.
        self.names = sorted(self.usable | joined | {p for p in pieces if len(p) == 1})
        self.number = {p: k for k, p in enumerate(self.names)}
        pairs: dict[str, set[int]] = {}
        for p in self.usable:
            if len(p) > 1:
                pairs.setdefault(p[-2:], set()).add(len(p))
        ends = {k: {2} & v for k, v in pairs.items()}
        for p in self.usable:
            if len(p) > 2:
                ends.setdefault(p[-3:], {2} & pairs[p[-2:]]).add(len(p))
        #: Lengths of the usable pieces that end in three given characters, the longest first; if there are none, in two.
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        normalise = None
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            normalise = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == 6]
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        return cls(pieces, kind, byte_ids if len(byte_ids) == 256 else None, unknown, proto.normalizer_spec.add_dummy_prefix, normalise)

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored joint first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best[0]):
                    best = found[1], i
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        """Whether the piece, merged from its characters, is one piece; remembers its last joint."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.merge(piece) == [piece]
            if known and len(piece) > 1:  # its last joint: the cut whose halves stay apart until the end
                self._joint[piece] = len(self._halves(piece)[0])
        return known

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge ends the merging of piece."""
        parts, before = list(piece), None
        while len(parts) > 1:
            before = parts
            scored = [(self.pieces[x][1], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.pieces]
            i = -max(scored)[1]
            parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]
        return before[0], before[1]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the pieces numbered a and b, merged together, stay as they are; answers are kept, up to a bound."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        known = self._pairs[a * len(self.names) + b] = self._stay_apart(self.names[a], self.names[b])
        return known

    def _stay_apart(self, a: str, b: str) -> bool:
        """neighbours, worked out.

        Undo the later of the two last joints again and again; if some joint across the border would have come before
        the joint just undone (a tie goes to the left), merging crosses the border.
        """
        if a[-1] == BLANK:  # pieces of blanks share one score, so their order isn't that of scores
            return self.merge(a + b) == [a, b]
        pieces, limit = self.pieces, -math.inf
        while True:
            across = pieces.get(a + b)
            if across and across[1] > limit:
                return False
            sa = pieces[a][1] if len(a) > 1 else math.inf
            sb = pieces[b][1] if len(b) > 1 else math.inf
            if sa < sb:
                limit = sa
                self.whole(a)
                a = a[self._joint[a] :]
            elif len(b) == 1:
                return True
            else:
                limit = math.nextafter(sb, -math.inf)
                self.whole(b)
                b = b[: self._joint[b]]

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]


class StreamingViterbi:
    """Feed text in any cuts; committed() gives the pieces that are final so far."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # from the last committed boundary on
        self.back = [0]  # of each position: the length of its last piece
        self.score = [0.0]  # of each position, for unigram: the path's score
        self.piece = [-1]  # of each position, for bpe: the number of its last piece; -1 joins with nothing
        self.out: list[str] = []
        self.last = ""  # the last committed piece
        self.held = 0  # most positions held at once

    def feed(self, text: str) -> None:
        m = self.model
        step, size = (self._score if m.kind == "unigram" else self._merge), STEP * m.longest
        for k in range(0, len(text), size):
            start = len(self.text)
            self.text += text[k : k + size]
            step(start)
            self.held = max(self.held, len(self.back))
            if len(self.text) > m.longest:
                self._commit()

    def _lengths(self, j: int) -> tuple[int, ...]:
        """Lengths of the pieces of two characters or more that may end at position j, the longest first."""
        found = self.model.ends.get(self.text[max(0, j - 3) : j])
        return self.model.ends.get(self.text[max(0, j - 2) : j], ()) if found is None else found

    def _merge(self, start: int) -> None:
        """Backpointers of the positions after start: the one edge that the path before it allows.

        Those of a word after a blank depend on nothing before it, so a word goes on from its longest beginning whose
        backpointers are kept.
        """
        m, text, back, pieces = self.model, self.text, self.back, self.piece
        ends, number, pairs, size, kept = m.ends.get, m.number.get, m._pairs.get, len(m.names), m._beginnings
        if len(kept) > BEGINNINGS:
            kept.clear()
        n, j, word = len(text), start, -1
        before = text[start - 1] if start else self.last[-1:]
        while j < n:
            char = text[j]
            if char == BLANK and before != BLANK and m.blank_leads:
                pieces[j] = -1  # no piece reaches across
                word = j
                for size_kept in range(min(n - j, BEGINNING_CHARS), 0, -1):
                    found = kept.get(text[j : j + size_kept])
                    if found:
                        back += found[0][:size_kept]
                        pieces += found[1][:size_kept]
                        j += size_kept
                        before = text[j - 1]
                        break
                else:
                    found = None
                if found:
                    continue
            j += 1
            before = char
            lengths = ends(text[j - 3 : j] if j > 2 else "")
            for length in (ends(text[j - 2 : j], ()) if j > 1 else ()) if lengths is None else lengths:
                i = j - length
                piece = number(text[i:j]) if i >= 0 else None
                if piece is None:
                    continue
                last = pieces[i]
                if last < 0:
                    break
                known = pairs(last * size + piece)
                if m.neighbours(last, piece) if known is None else known:
                    break
            else:
                i, piece = j - 1, number(char, -1)
            back.append(j - i)
            pieces.append(piece)
            if 0 <= word and j - word <= BEGINNING_CHARS:
                if j == n or j - word == BEGINNING_CHARS or text[j] == BLANK:
                    own = back[word + 1 : j + 1], pieces[word + 1 : j + 1]
                    for k in range(j, word, -1):
                        if kept.setdefault(text[word:k], own) is not own:
                            break

    def _score(self, start: int) -> None:
        """Backpointers of the positions after start: the edge with the best sum of scores."""
        m, text, back, scores = self.model, self.text, self.back, self.score
        for j in range(start + 1, len(text) + 1):
            found = m.pieces.get(text[j - 1 : j])
            best, size = scores[j - 1] + (found[1] if found else m.lowest), 1
            for length in self._lengths(j):
                found = m.pieces.get(text[j - length : j]) if length <= j else None
                if found and scores[j - length] + found[1] >= best:
                    best, size = scores[j - length] + found[1], length
            back.append(size)
            scores.append(best)

    def _commit(self) -> None:
        """Commit up to the furthest boundary that the paths of all positions still in reach share."""
        n, back = len(self.text), self.back
        reach = max(0, n - self.model.longest + 1)
        live = bytearray(reach) + b"\x01" * (n + 1 - reach)
        left, at = n + 1 - reach, n
        while left > 1:
            if live[at]:
                before = at - back[at]
                if live[before]:
                    left -= 1
                else:
                    live[before] = 1
            at -= 1
        self._emit(live.index(1, 0, at + 1))

    def _emit(self, upto: int) -> None:
        if not upto:
            return
        text, back, found, at = self.text, self.back, [], upto
        while at:
            found.append(text[at - back[at] : at])
            at -= back[at]
        found.reverse()
        self.out += found
        self.last = found[-1]
        self.text = text[upto:]
        self.back = back[upto:]
        if self.model.kind == "unigram":
            base = self.score[upto]
            self.score = [x - base for x in self.score[upto:]]
        else:
            self.piece = self.piece[upto:]

    def committed(self) -> list[str]:
        out, self.out = self.out, []
        return out

    def close(self) -> list[str]:
        self._emit(len(self.text))
        return self.committed()


class PieceCoder:
    """Whole texts to little-endian uint32 ids and back."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.cache = Cache()  # by stretch: a word after a blank, a line break and the word after it, or blanks and a word
        self.packed = {p: struct.pack("<I", i) for p, (i, _) in model.pieces.items()}
        self.marks = {c: self._packed(c) for c in model.closing}

    def _packed(self, piece: str) -> bytes:
        found = self.packed.get(piece)
        return b"".join(struct.pack("<I", i) for i in self.model.ids_of(piece)) if found is None else found

    def _pieces(self, text: str) -> list[str]:
        viterbi = StreamingViterbi(self.model)
        viterbi.feed(text)
        return viterbi.close()

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words after a blank (or a line break of their own), by one lattice over all of them."""
        stream = "".join([w if w[0] == "\n" else BLANK + w for w in words])
        packed, parts, ids = self.packed, [], []
        for piece in self._pieces(stream):
            if (piece[0] == BLANK or piece == "\n") and ids:
                parts.append(b"".join(ids))
                ids = []
            ids.append(packed.get(piece) or self._packed(piece))
        parts.append(b"".join(ids))
        return dict(zip(words, parts, strict=True))

    def _looked_up(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        found = list(map(cache.young.get, words))
        if None not in found:
            return found
        new: dict[str, bytes | None] = {}
        later: list[tuple[int, str, bytes]] = []
        closing, marks = self.model.closing, self.marks
        for k, ids in enumerate(found):
            if ids is None:
                word, tail = words[k], b""
                if word[-1] in closing and word[-2:-1].isalpha():  # a mark that no piece joins to the letter before it
                    word, tail = word[:-1], marks[word[-1]]
                    ids = cache.young.get(word)
                ids = cache.again(word) if ids is None else ids
                if ids is None:
                    new[word] = None
                    later.append((k, word, tail))
                else:
                    found[k] = ids + tail
        if new:
            made = self._new(list(new))
            for word, ids in made.items():
                cache.put(word, ids)
            for k, word, tail in later:
                found[k] = made[word] + tail
        return found

    def encode(self, text: str) -> bytes:
        m = self.model
        if m.normalise:
            text = m.normalise(text)
        text = text.replace(BLANK, " ")
        if not text:
            return b""
        whole = (" " if m.dummy_prefix else "") + text
        if not (m.blank_leads and m.alone and m.dummy_prefix):
            return b"".join(map(self._packed, self._pieces(whole.replace(" ", BLANK))))
        words = whole.replace("\n", " \n").split(" ")
        words.pop(0)  # what stands before the first blank: nothing
        if "" not in words:
            return b"".join(self._looked_up(words))
        out, plain = [], []  # runs of blanks belong to what follows them, so such stretches have a lattice of their own
        for part in re.findall("\n[^ \n]*| *[^ \n]+| +", whole):
            if part[0] == "\n" or part[:2] != "  " and part != " ":
                plain.append(part if part[0] == "\n" else part[1:])
                continue
            out += self._looked_up(plain)
            plain = []
            out.append(b"".join(map(self._packed, self._pieces(part.replace(" ", BLANK)))))
        return b"".join([*out, *self._looked_up(plain)])

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become replacement signs."""
        if not hasattr(self, "_table"):
            self._table = {**self.model.texts, **self.model.bytes_of, self.model.unknown: b" \xe2\x81\x87 "}
        text = b"".join(map(self._table.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_coders: dict[str, PieceCoder] = {}


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_ids, ids, the text decoded from them, whether it equals the text, and how
    many U+2581 the text has (with none, it does)."""
    import numpy as np

    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _coders:
            _coders[model_path] = PieceCoder(PieceModel.load(model_path))
        coder = _coders[model_path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [np.frombuffer(coder.encode(t), "<u4").astype(np.int32) for t in texts]
            decoded = [coder.decode(x.tolist()) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            same, signs = [a == b for a, b in zip(decoded, texts, strict=True)], [t.count(BLANK) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(decoded), pa.array(same), pa.array(signs, pa.int64())],
                names=["doc_id", "n_ids", "ids", "decoded", "round_trip", "blank_signs"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded string, round_trip boolean, blank_signs long")
