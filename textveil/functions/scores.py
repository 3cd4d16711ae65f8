"""Scores of texts as Columns: proxies that need no model, and what is derived from a model's output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.text import CHUNK, RUN, despaced_skeleton, let, skeleton

# Words of the keyword proxy.
KEYWORDS = tuple("dummy doofus nitwit stupid idiot moron loser clown jerk fool silly pathetic useless worthless trash garbage".split())
# Labels that mean hate, identity labels and their category, and types by severity.
HATE_LABELS = ("hate", "offensive", "abusive", "toxic", "hateful", "label_1")
CATEGORIES = {
    "christian": "religion", "jewish": "religion", "muslim": "religion", "male": "gender", "female": "gender",
    "homosexual_gay_or_lesbian": "orientation", "black": "ethnicity", "white": "ethnicity", "psychiatric_or_mental_illness": "other",
}
HIGH_TYPES = ("threat", "severe_toxicity", "identity_attack")
MEDIUM_TYPES = ("insult", "obscene", "sexual_explicit")


def term_skeletons(terms: Sequence[str]) -> Column:
    """Sorted distinct skeletons of at least three characters."""
    made = F.transform(F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>"), skeleton)
    return F.array_sort(F.array_distinct(F.filter(made, lambda s: F.length(s) >= 3)))


def skeletons_held(text: Column, skeletons: Column) -> Column:
    """Those of skeletons that equal a token's skeleton or lie in that of the text without blanks.

    An ASCII one that equals a token's lies in the whole text's too (only letters such as the final sigma depend on where
    a word ends), so tokens are cut for other skeletons only.
    """
    text = F.coalesce(text, F.lit(""))
    own = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(CHUNK), 0), skeleton))
    other = F.exists(skeletons, lambda s: s.rlike(r"[^\x00-\x7F]"))
    seen = F.struct(F.when(other, own).otherwise(F.array().cast("array<string>")).alias("own"), despaced_skeleton(text).alias("whole"))
    return let(seen, lambda t: F.filter(skeletons, lambda s: F.contains(t["whole"], s) | F.array_contains(t["own"], s)))


def lexicon_proxy(text: Column, terms: Sequence[str]) -> Column:
    return (F.size(skeletons_held(text, term_skeletons(terms))) > 0).cast("int")


def keyword_proxy(text: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), 0), F.array(*(F.lit(k) for k in KEYWORDS))).cast("int")


def keyword_share(text: Column) -> Column:
    """A stand-in for a model's probability: one minus 0.5 to the number of keywords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), 0)
    return F.lit(1.0) - F.pow(F.lit(0.5), F.size(F.filter(words, lambda w: w.isin(*KEYWORDS))).cast("double"))


#: It counts words: a token without keywords changes no text's score.
keyword_share.additive = True


def hate_probability(logits: Column, names: Sequence[str], multi_label: bool, label: str = "toxicity") -> Column:
    """From a model's logits: the named label's sigmoid, or the softmax mass of labels that mean hate (else the last)."""
    lower = [n.lower() for n in names]
    if multi_label:
        at = lower.index(label) if label in lower else next((i for i, n in enumerate(lower) if label in n), 0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logits[at]))
    wanted = [i for i, n in enumerate(lower) if any(h in n for h in HATE_LABELS)] or [len(names) - 1]
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return sum((F.exp(logits[i] - top) for i in wanted), F.lit(0.0)) / total


def severity(probability: Column) -> Column:
    return F.when(probability < 0.5, "none").when(probability >= 0.8, "high").when(probability >= 0.65, "medium").otherwise("low")


def confidence(probability: Column) -> Column:
    return F.round(F.greatest(probability, 1 - probability), 3)


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.85, "high").when(value >= 0.70, "medium").otherwise("low")


def label_severity(scores: Column) -> Column:
    """From a map of label to probability."""
    get = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    any_of = lambda names: F.greatest(*(get(n) for n in names)) >= 0.5
    return F.when(get("toxicity") < 0.5, "none").when(any_of(HIGH_TYPES), "high").when(any_of(MEDIUM_TYPES), "medium").otherwise("low")


def label_category(scores: Column) -> Column:
    """Category of the best identity label (the first of equals) if the text is flagged and the label is at least 0.5."""
    get = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    ranked = F.array_max(F.array(*(F.struct(get(k).alias("p"), F.lit(-i).alias("rank"), F.lit(c).alias("category")) for i, (k, c) in enumerate(CATEGORIES.items()))))
    return F.when((get("toxicity") >= 0.5) & (ranked["p"] >= 0.5), ranked["category"])
