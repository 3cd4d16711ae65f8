"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

Every rule is a regular expression together with the literal tokens any matching URL must contain. The rules are
indexed under the one of these tokens that the URLs at hand contain least often. A URL's distinct tokens fetch its
candidate rules by an equi-join, and only those candidates run their expressions. A rule without a literal token is
indexed under the empty token, which every URL has, so it is a candidate for all. Host rules (a host with its
subdomains and a path prefix) are the same thing: their tokens are the labels of the host and the words of the path.

The rule table has a row a rule and is broadcast: its size is the length of the rule list, checked below, and never
depends on the pages; a longer list is joined by shuffle.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed; repeated
page_ids give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import written

#: Rule lists up to this length are broadcast.
BROADCAST_RULES = 20_000
#: The token of rules that have none: no word is empty.
EVERY = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name is reported. pattern is matched against "host path" (lower-cased host, one space, path as it is)."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    specific: int
    host_rule: bool


def tokens_of(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall("[a-z0-9]+", literal.lower())))


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the path starts with path.

    A prefix may end within a word of the path, so a word at its very end is no token.
    """
    whole = re.sub(r"[A-Za-z0-9]+\Z", "", path)
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + " " + re.escape(path)
    return Rule(host + path, pattern, tokens_of(host) + tokens_of(whole), verdict, len(host + path), True)


def word_rule(verdict: str, name: str, pattern: str, literal: str) -> Rule:
    """A rule for any host: pattern on "host path"; literal holds words that stand whole in every match."""
    return Rule(name, pattern, tokens_of(literal), verdict, len(name), False)


#: Rules for hosts no host rule covers: pages that hold no prose. A block by any of them blocks.
DEFAULT_PATTERNS: tuple[Rule, ...] = (
    word_rule("block", "login page", r" .*/login(?:[/?#.]|$)", "login"),
    word_rule("block", "sign-in page", r" .*/signin(?:[/?#.]|$)", "signin"),
    word_rule("block", "shopping cart", r" .*/cart(?:[/?#.]|$)", "cart"),
    word_rule("block", "checkout", r" .*/checkout(?:[/?#.]|$)", "checkout"),
    word_rule("block", "casino host", r"^(?:[^/]*[.-])?casino[.-][^/]* (?:/|$)", "casino"),
    word_rule("block", "betting host", r"^(?:[^/]*[.-])?betting[.-][^/]* (?:/|$)", "betting"),
    word_rule("block", "adult host", r"^(?:[^/]*[.-])?porn[.-][^/]* (?:/|$)", "porn"),
    word_rule("block", "adult label", r"^(?:[^/]*[.-])?xxx(?:[.-][^/]*)? (?:/|$)", "xxx"),
    word_rule("block", "tag listing", r" /tag/[^/]+/page/[0-9]+", "tag page"),
    word_rule("block", "search results", r" /search(?:[/?#]|$)", "search"),
    word_rule("block", "administration page", r" .*/wp-admin(?:[/?#]|$)", "wp admin"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for a null URL or one without "://"."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def index_rules(spark, rules: Sequence[Rule], urls: DataFrame) -> DataFrame:
    """The rules keyed by token: of a rule's tokens, the one in the fewest of urls (tokens array), ties to the first name."""
    rows = [(i, r.name, r.pattern, list(r.tokens) or [EVERY], r.verdict, r.specific, r.host_rule) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_no int, name string, pattern string, tokens array<string>, rule_verdict string, specific int, host_rule boolean")
    words = table.select(F.explode("tokens").alias("token")).distinct()
    words = F.broadcast(words) if len(rules) <= BROADCAST_RULES else words
    counts = urls.select(F.explode("tokens").alias("token")).join(words, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    keyed = table.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    rarest = keyed.groupBy("rule_no").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    return written(spark, table.drop("tokens").join(rarest, "rule_no"), "url-rules")


def judge(pages: DataFrame, rules: Sequence[Rule], otherwise: Sequence[Rule] = DEFAULT_PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule.

    The longest fitting host rule decides and is named in rule. Where none fits, rule is null and the verdict is
    block if a pattern of otherwise matches (named in pattern_rule), else allow.
    """
    spark, everything = pages.sparkSession, [*rules, *otherwise]
    host, path = split_url(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("[a-z0-9]+"), 0))
    if not all(r.tokens for r in everything):
        words = F.concat(words, F.array(F.lit(EVERY)))
    split = split.withColumn("tokens", words)
    index = index_rules(spark, everything, split)
    # A row for each distinct host and path: what many pages share is judged once, and a hot host is spread by path.
    sites = split.groupBy("host", "path").agg(F.first("tokens").alias("tokens"))
    candidates = sites.select("host", "path", F.explode("tokens").alias("token")).join(
        F.broadcast(index) if len(everything) <= BROADCAST_RULES else index, "token"
    )
    fits = candidates.where(F.expr("concat_ws(' ', host, path) rlike pattern"))
    order = F.struct(F.col("host_rule").alias("host_rule"), "specific", F.col("name").alias("name"), "rule_verdict")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.host_rule"), F.col("best.name")).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.host_rule"), F.col("best.name")).alias("pattern_rule"),
    )
