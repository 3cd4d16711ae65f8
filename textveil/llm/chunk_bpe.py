"""Whole-text encoding with the tokenizers library, one cached call per distinct chunk.

A byte-pair encoder works on pre-tokens, so a text can be cut wherever a pre-token must end and the pieces encoded
apart. Chunks repeat a lot; the library sees each distinct chunk once per worker and the ids are joined as bytes.
"""

from __future__ import annotations

import re
import sys
from array import array

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are 32-bit integers in little-endian order, which this machine's are not")

#: Entries in each of a cache's two generations; bounds a worker's memory.
CACHE_ENTRIES = 350_000
#: Longer chunks are encoded each time.
CACHED_CHARS = 64

_TROUBLE = re.compile(r"[ \n](?=\s|\Z)")
_SURE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A mark that ends a pre-token of letters and starts one of marks.
_CLOSING = frozenset(".,;:!?|)")


class Cache:
    """Chunk to ids. When the young generation is full it becomes the old one; chunks in use move back."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= CACHED_CHARS:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids

    def add(self, found: dict[str, bytes]) -> None:
        """put for many at once."""
        if len(self.young) + len(found) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young.update(found if max(map(len, found)) <= CACHED_CHARS else {c: ids for c, ids in found.items() if len(c) <= CACHED_CHARS})

    def again(self, chunk: str) -> bytes | None:
        ids = self.old.get(chunk)
        if ids is not None:
            self.put(chunk, ids)
        return ids


class ChunkEncoder:
    """Little-endian uint32 ids of whole texts.

    leading_space: the vocabulary's pre-tokens carry the blank before a word (byte-level style); otherwise blanks
    only separate words and are dropped. Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, leading_space: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.leading_space = leading_space
        self.bare, self.spaced, self.marks = Cache(), Cache(), {}

    def encode(self, text: str) -> bytes:
        """Ids of one text; an empty text has none."""
        if not text:
            return b""
        if not self.leading_space:
            return b"".join(self._look_up(self.spaced, text.replace("\n", " ").split(" "), ""))
        if _TROUBLE.search(text):  # runs of blanks: cut only between a blank with text on both sides
            first, *rest = _SURE_CUT.split(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
        return self._look_up(self.bare, [first], "")[0] + b"".join(self._look_up(self.spaced, rest, " "))

    def _look_up(self, cache: Cache, chunks: list[str], prefix: str) -> list[bytes]:
        found = list(map(cache.young.get, chunks))
        if None not in found:
            return found
        # A word and its closing mark are looked up apart; what is still unknown goes to the library in one call.
        new: dict[str, bytes | None] = {}
        later: list[tuple[int, str, bytes]] = []
        young, old = cache.young.get, cache.old.get
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word, tail, ids = chunks[i], b"", None
            if word[-1:] in _CLOSING and word[-2:-1].lower().isalpha():
                tail, word = self._mark(word[-1]), word[:-1]
                ids = young(word)
            if ids is None:
                ids = old(word)
                if ids is None:
                    new[word] = None
                    later.append((i, word, tail))
                    continue
                cache.put(word, ids)
                young, old = cache.young.get, cache.old.get
            found[i] = ids + tail
        if new:
            order = list(new)
            # a chunk that starts with its own line break never had a blank before it
            texts = [c if c[:1] == "\n" else prefix + c for c in order] if prefix else order
            for c, e in zip(order, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                new[c] = array("I", e.ids).tobytes()
            cache.add(new)
            for i, word, tail in later:
                found[i] = new[word] + tail if tail else new[word]
        return found

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = array("I", self.library.encode(mark, add_special_tokens=False).ids).tobytes()
        return self.marks[mark]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def largest_id(path: str) -> int:
    """The largest id of a vocabulary, special tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def worker_encoder(path: str, leading_space: bool) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, leading_space) not in _encoders:
        _encoders[path, leading_space] = ChunkEncoder(path, leading_space)
    return _encoders[path, leading_space]
