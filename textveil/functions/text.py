"""Text functions as Columns: tokens, normalisation, skeletons, overlaps. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.config import Normalisation

# The patterns of a token (a URL, a mention, a hashtag, or a word with inner apostrophes and hyphens), of a run of
# letters and digits, and of a piece between blanks.
TOKEN = r"(?U)(?:https?://|www\.)\S+|@\w+|#\w+|[^\W_]+(?:['’\-][^\W_]+)*"
RUN = r"(?U)[^\W_]+"
CHUNK = r"(?U)\S+"

# What stands for a letter in obfuscated spelling.
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
# Typographic marks and what they become.
MARKS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‒": "-", "―": "-", " ": " ", " ": " ", " ": " ", " ": " "}
# Informal spellings.
MISSPELLINGS = {
    "u": "you", "ur": "your", "r": "are", "n": "and", "im": "i'm", "dont": "don't", "cant": "can't", "wont": "won't", "didnt": "didn't",
    "doesnt": "doesn't", "isnt": "isn't", "wasnt": "wasn't", "arent": "aren't", "couldnt": "couldn't", "shouldnt": "shouldn't",
    "wouldnt": "wouldn't", "youre": "you're", "theyre": "they're", "gonna": "going to", "wanna": "want to", "gotta": "got to",
    "cuz": "because", "becuz": "because", "thru": "through", "tho": "though", "pls": "please", "plz": "please", "thx": "thanks", "ppl": "people",
}
# Closed-class English words.
FUNCTION_WORDS = tuple(
    dict.fromkeys(
        """
    a an the this that these those some any no each every both either neither
    i me my mine myself you your yours yourself he him his himself she her hers
    herself it its itself we us our ours ourselves they them their theirs
    themselves who whom whose which what
    is am are was were be been being do does did doing have has had having
    will would shall should can could may might must ought
    and or but nor for yet so because although though while if unless until
    when where why how than as that whether
    of in on at by to from with about against between into through during before
    after above below up down out off over under again further then once here
    there all very too just only also even still not no nor
    """.split()
    )
)


@cache
def emoji_class() -> str:
    """The pictographs' code points as ranges of a character class, from the Unicode data of the regex module."""
    import regex

    every = "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    ranges = [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(r"\p{Extended_Pictographic}+", every)]
    ranges += [(0x1F1E6, 0x1F1FF), (0xFE0F, 0xFE0F), (0x200D, 0x200D)]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: What no text without pictographs holds, but for some marks and scripts: a test that is cheap next to emoji_class().
MAYBE_EMOJI = r"[\x{A9}\x{AE}\x{200D}-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda nothing else keeps an expression from being repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def separators(text: Column) -> Column:
    """What stands before, between and after the tokens: one more than there are tokens."""
    return F.split(text, TOKEN, -1)


def kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(?:https?://|www\.)."), "url")
        .when(token.startswith("@"), "mention")
        .when(token.startswith("#"), "hashtag")
        .otherwise("word")
    )


def interleave(seps: Column, toks: Column) -> Column:
    """seps[0] toks[0] seps[1] ... as one string."""
    return F.concat(F.array_join(F.zip_with(seps, toks, lambda s, t: F.concat(s, F.coalesce(t, F.lit("")))), ""), F.lit(""))


def normalize_sep(text: Column, rules: Normalisation = Normalisation()) -> Column:
    if rules.strip_emoji:
        text = F.when(text.rlike(MAYBE_EMOJI), F.regexp_replace(text, emoji_class(), "")).otherwise(text)
    if rules.normalize_punctuation:
        text = F.replace(F.translate(text, "".join(MARKS), "".join(MARKS.values())), F.lit("…"), F.lit("..."))
        text = F.regexp_replace(text, r"(?U)([^\w\s])\1+", "$1")
    if rules.collapse_whitespace:
        text = F.regexp_replace(text, r"(?U)\s+", " ")
    return text


def misspelling(word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MISSPELLINGS.items() for x in pair)), word), word)


def normalize_word(word: Column, rules: Normalisation = Normalisation()) -> Column:
    word = F.lower(word) if rules.lowercase else word
    word = F.regexp_replace(word, r"(.)\1{2,}", "$1") if rules.repair_elongation else word
    return misspelling(word) if rules.fix_misspellings else word


def word_reasons(word: Column, rules: Normalisation = Normalisation()) -> Column:
    """What normalize_word changes, joined by plus signs; empty if nothing."""
    low = F.lower(word) if rules.lowercase else word
    short = F.regexp_replace(low, r"(.)\1{2,}", "$1") if rules.repair_elongation else low
    fixed = misspelling(short) if rules.fix_misspellings else short
    return F.concat_ws("+", F.when(low != word, "lowercased"), F.when(short != low, "de-elongated"), F.when(fixed != short, "misspelling"))


def normalize_text(text: Column, rules: Normalisation = Normalisation()) -> Column:
    toks = F.transform(tokens(text), lambda t: F.when(kind(t) == "word", normalize_word(t, rules)).otherwise(t))
    return interleave(normalized_separators(separators(text), rules), toks)


def normalized_separators(seps: Column, rules: Normalisation = Normalisation()) -> Column:
    """normalize_sep of each; a single blank, as most of them are, is what it was."""
    return F.transform(seps, lambda s: F.when(s.isin("", " "), s).otherwise(normalize_sep(s, rules)))


def skeleton(token: Column) -> Column:
    """Lower case, leet signs as letters, letters and digits only, runs of one character collapsed."""
    plain = F.translate(F.lower(token), "".join(LEET), "".join(LEET.values()))
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""), r"(.)\1+", "$1")


def despaced_skeleton(text: Column) -> Column:
    return skeleton(F.regexp_replace(text, r"(?U)\s+", ""))


def alnum_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}]", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(RUN), 0))


def classify_word(word: Column) -> Column:
    word = F.lower(F.trim(word))
    return (
        F.when(word == "", "content")
        .when(word.rlike(r"^\p{Nd}+$"), "number")
        .when(F.split_part(word, F.lit(" "), F.lit(1)).isin(*FUNCTION_WORDS), "function_word")
        .otherwise("content")
    )


def token_class(token: Column) -> Column:
    return F.when(kind(token) == "word", classify_word(token)).otherwise(kind(token))


def edit_ratio(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def edit_ratio_below(a: Column, b: Column, bound: float) -> Column:
    """edit_ratio(a, b) < bound, by a distance that is given up beyond the bound: a band of the table, not all of it."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    found = F.call_function("levenshtein", a, b, F.ceil(longer * F.lit(max(bound, 0.0))).cast("int") + 1)
    return (found >= 0) & (found / longer < bound)


def char_ngrams(text: Column, n: int = 3) -> Column:
    def cut(kept: Column) -> Column:
        starts = F.when(F.length(kept) >= n, F.sequence(F.lit(1), F.length(kept) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(kept, i, F.lit(n))))

    return let(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", ""), cut)


def ngram_overlap(a: Column, b: Column, n: int = 3) -> Column:
    def share(own: Column) -> Column:
        return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, char_ngrams(b, n))) / F.size(own))

    return let(char_ngrams(a, n), share)


def tokens_changed(before: Column, after: Column) -> Column:
    """Places where the blank-separated words differ, and the difference in their number."""
    a, b = (F.regexp_extract_all(x, F.lit(CHUNK), 0) for x in (before, after))
    differ = F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 0).when(x != y, 1).otherwise(0))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))
