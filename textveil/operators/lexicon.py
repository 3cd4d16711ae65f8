"""Protected terms: obfuscated spellings found by one regular expression, overlaps resolved, canonical forms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.scores import skeletons_held, term_skeletons
from textveil.functions.text import let, skeleton

# Signs that may stand for a letter.
VARIANTS = {"a": "4@", "b": "8", "c": "(", "e": "3", "g": "69", "i": "1!|", "l": "1|", "o": "0", "s": "5$", "t": "7+", "z": "2"}
SHORTEST = 3
#: Terms in one alternation.
TERMS_IN_PATTERN = 300


def clean_terms(terms: Sequence[str]) -> list[str]:
    """Trimmed, lower case, distinct, in order."""
    return list(dict.fromkeys(t for t in ((x or "").strip().lower() for x in terms) if t))


def _quoted(ch: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", ch)


def term_pattern(term: str, max_gap: int = 2) -> str:
    """Java pattern of a term's spellings; a term of under three characters is itself."""
    if len(term) < SHORTEST:
        return "".join(map(_quoted, term))
    parts = []
    for ch in term:
        if ch.isalpha():
            parts.append("[" + ch + "".join(map(_quoted, VARIANTS.get(ch, ""))) + "]+")
        else:
            parts.append(_quoted(ch) + ("+" if ch.isdigit() else ""))
    return f"[\\W_]{{0,{max(0, max_gap)}}}".join(parts)


def bounded(patterns: Sequence[str]) -> str:
    return r"(?iU)(?<![0-9\p{L}])(?:" + "|".join(patterns) + r")(?![0-9\p{L}])"


def canonical_of(match: Column, terms: Sequence[str], max_gap: int = 2) -> Column:
    """The first term whose pattern is all of match."""
    tries = [F.when(match.rlike(f"(?iU)^(?:{term_pattern(t, max_gap)})$"), F.lit(t)) for t in terms]
    return F.coalesce(*tries, F.lower(F.trim(match)))


def spans(text: Column, terms: Sequence[str], max_gap: int = 2) -> Column:
    """array of (start, end, canonical), by start. Offsets are in characters.

    Each alternation gives its leftmost matches; between alternations the longest match wins, then the leftmost.
    """
    terms = clean_terms(terms)
    empty = F.array().cast("array<struct<start:int,end:int,canonical:string>>")
    groups = [terms[i : i + TERMS_IN_PATTERN] for i in range(0, len(terms), TERMS_IN_PATTERN)]
    if not groups:
        return empty
    found = []
    for group in groups:
        # the fold below is built at once, so it sees this group's terms
        pattern = bounded([term_pattern(t, max_gap) for t in group])
        matches, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
        lengths = F.zip_with(between, matches, lambda s, m: F.struct(F.length(s).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), m.alias("m")))
        placed = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.when(
                    x["m"].isNotNull(),
                    F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), canonical_of(x["m"], group, max_gap).alias("canonical")))),
                )
                .otherwise(a["out"])
                .alias("out"),
            ),
        )["out"]
        found.append(placed)
    return found[0] if len(found) == 1 else resolve(F.flatten(F.array(*found)))


def resolve(raw: Column) -> Column:
    """Spans without overlaps: the longest first, then the leftmost; in order of start."""
    size = lambda s: s["end"] - s["start"]
    ordered = F.array_sort(raw, lambda a, b: F.when(size(a) != size(b), size(b) - size(a)).otherwise(a["start"] - b["start"]))
    chosen = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,end:int,canonical:string>>"),
        lambda acc, x: F.when(F.exists(acc, lambda o: (x["start"] < o["end"]) & (x["end"] > o["start"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_sort(chosen)


def protected_terms(text: Column, terms: Sequence[str], max_gap: int = 2) -> Column:
    """Sorted distinct canonical terms, found by pattern or by skeleton."""
    terms = clean_terms(terms)
    if not terms:
        return F.array().cast("array<string>")
    by_pattern = F.array_compact(F.array(*(F.when(text.rlike(bounded([term_pattern(t, max_gap)])), F.lit(t)) for t in terms)))
    if len(terms) <= TERMS_IN_PATTERN:
        # one pass over the many texts without any
        some = text.rlike(bounded([term_pattern(t, max_gap) for t in terms]))
        by_pattern = F.when(some, by_pattern).otherwise(F.array().cast("array<string>"))
    known = F.array(*(F.struct(F.lit(t).alias("term"), skeleton(F.lit(t)).alias("skeleton")) for t in terms))
    held = skeletons_held(text, term_skeletons(terms))
    by_skeleton = let(held, lambda h: F.transform(F.filter(known, lambda k: F.array_contains(h, k["skeleton"])), lambda k: k["term"]))
    return F.array_sort(F.array_distinct(F.concat(by_pattern, by_skeleton)))


def spans_preserved(candidate: Column, skeletons: Column) -> Column:
    """Whether every skeleton is a token's or lies in the text without blanks; true for none."""
    return F.size(F.array_except(skeletons, skeletons_held(candidate, skeletons))) == 0
