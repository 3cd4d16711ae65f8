"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Line rules, on lines that hold a word (blank lines are neither kept words nor a loss):

* punctuation: the line neither ends in a closing mark nor holds the end of a sentence, or a third of its words carry doubled marks;
* navigation: menu separators stand between its words, or it is a few menu words;
* boilerplate: a short line with a phrase that sites repeat on every page;
* shouting: most letters of a line of five words or more are capitals.

Whole-document figures come with the verdict (see base_figures). Every text is read whole; documents are independent,
so there is no shuffle and a lost task only repeats its rows.

Defined cases: a null text has no words and fails; an empty text likewise; ties do not arise; repeated rows give a row
each; an empty table gives no rows; other columns pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textveil.llm.common import id_and_text, small_batches

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"

# Fixed values of the line rules.
CLOSING_MARKS = tuple(".!?…:;,\"'”’»)]}。！？")
MENU_WORDS = frozenset("home menu login logout register search contact about help next previous back top share print sitemap faq".split())
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter",
    "click here", "powered by", "lorem ipsum",
)
BOILERPLATE_WORDS = 30
MARKED_SHARE, SHOUTED_SHARE, MENU_SHARE = 1 / 3, 0.6, 0.2
#: A document that loses more than this share of its words is rejected.
LOSS_LIMIT = 0.5

_DOUBLED = re.compile(r"([!?#*$%&=~^|<>])\1")
_SEPARATORS = re.compile(r"(?:^|[ \t])(?:\||»|>|•|·|/)(?=[ \t]|$)")
_SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)\\]]*\\s")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))


def failed_rule(line: str) -> str | None:
    """The first rule that a line with words fails; None if it stays."""
    line = line.strip(_SPACES)
    words = len(line.split())
    if len(_SEPARATORS.findall(line)) >= max(2, MENU_SHARE * words):
        return "navigation"
    if words <= 8 and all(w.strip(".,:|").lower() in MENU_WORDS for w in line.split()):
        return "navigation"
    if sum(1 for w in line.split() if _DOUBLED.search(w)) > MARKED_SHARE * words if _DOUBLED.search(line) else False:
        return "punctuation"
    if words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if words >= 5:
        capitals, small = sum(map(str.isupper, line)), sum(map(str.islower, line))
        if capitals > SHOUTED_SHARE * (capitals + small):
            return "shouting"
    return None if line.endswith(CLOSING_MARKS) or _SENTENCE_END.search(line) else "punctuation"


def clean(text: str) -> tuple[str, int, int]:
    """The text without its failing lines, their number and how many words went with them."""
    kept, lines, words = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n and failed_rule(line):
            lines += 1
            words += n
        else:
            kept.append(line)
    return "\n".join(kept), lines, words


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of words found twice or more in it.

    Windows are named exactly, by doubling: a pair of equal names is an equal window twice as long.
    """
    counts = np.array([len(t) for t in texts], np.int64)
    covered = np.zeros(len(texts), np.int64)
    n = int(counts.sum())
    if n < window:
        return covered
    index: dict[bytes, int] = {}
    names = np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), np.int64, n)
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        width += step
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.flatnonzero(owner[: len(names)] == owner[window - 1 :])
    keys = names[starts] * len(texts) + owner[starts]
    _, inverse, found = np.unique(keys, return_inverse=True, return_counts=True)
    starts = starts[found[inverse] > 1]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    inside = np.cumsum(edges)[:n] > 0
    np.add.at(covered, owner[inside], 1)
    return covered


def base_figures(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = [t.encode().split() for t in texts]
    repeated = repeated_words(words)
    out = []
    for text, own, n in zip(texts, words, repeated.tolist(), strict=True):
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        out.append((len(own), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n))
    return out


def judge_documents(docs: DataFrame, loss_limit: float = LOSS_LIMIT) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and what the line rules removed (cleaned: the text that stays)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            figures = base_figures(texts)
            cleaned = [clean(t) for t in texts]
            failed = [f[0] < 20 or 100 * f[4] > 30 * f[0] for f in figures]
            kept = [not bad and lost <= loss_limit * f[0] for bad, (_, _, lost), f in zip(failed, cleaned, figures, strict=True)]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*figures, strict=True)), pa.array(failed), pa.array(kept)]
            columns += [pa.array([c[k] for c in cleaned], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (0, pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return id_and_text(docs).mapInArrow(run, _DDL)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words", "cleaned"]
_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_removed_lines long, n_removed_words long, cleaned string"
)
