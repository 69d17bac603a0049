"""URL filtering by pattern rules, each indexed by its rarest literal token.

A rule is a host suffix and a path prefix, compiled to a regular expression. Its literal tokens are the labels of its
host and the complete segments of its path; every URL that it fits has them all. How often tokens occur is counted over
all URLs, and a rule is filed under the one that occurs least. A URL fetches the rules filed under its own tokens, and
only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    pattern: str  # host/path, as in "example.org/es/"
    verdict: str  # "allow" or "block"

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    @property
    def regex(self) -> str:
        quote = lambda s: re.sub(r"([^A-Za-z0-9/_\-])", r"\\\1", s)
        return rf"(?s)\A(?:[^/]*\.)?{quote(self.host)}{quote(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Labels of the host, then complete segments of the path with their slashes."""
        return [x for x in self.host.split(".") if x] + [f"/{x}/" for x in self.path.split("/")[1:-1]]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host labels, and path segments that a slash ends; and the empty token, under which rules without a literal are filed."""
    segments = F.split(path, "/")
    whole = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
    return F.array_distinct(F.concat(F.split(host, r"\."), F.transform(whole, lambda s: F.concat(F.lit("/"), s, F.lit("/"))), F.array(F.lit(""))))


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many rows each token of the rules occurs, over all rows; at most one count per token of a rule comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.lit(wanted))).alias("t"))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; ties go to the token that sorts first, rules without one to the empty token."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", otherwise: str = "allow", inline_rules: int = 5000) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced; others pass through, whatever their names).

    rule is the longest pattern whose host is the URL's host or a parent domain of it and whose path starts the URL's
    path; the verdict is the rule's. Without such a rule, rule is null and the verdict is otherwise. Of equal patterns the first counts. A
    null URL or one without :// has an empty host and path, and a rule that fits neither. Repeated and empty inputs are ordinary.

    Up to inline_rules rules the index is a hash table in the expression, which a URL's tokens look into: no exchange at all. More rules are joined by token
    on the distinct (host, path) pairs, which folds repeated URLs first, and the judgement is joined back.
    """
    rules = list({r.pattern: r for r in reversed([Rule(*r) for r in rules])}.values())
    urls = pages.drop("host", "path", "rule", "verdict") if {"host", "path", "rule", "verdict"} & set(pages.columns) else pages
    urls = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    index = rule_index(rules, token_counts(urls, rules))
    hit = unused(urls, "_hit")[0]
    if len(rules) <= inline_rules:
        out = urls.withColumn(hit, _best(index, urls.sparkSession))
    else:
        out = _joined(urls, index, hit)
    return out.withColumns({"rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["verdict"], F.lit(otherwise))}).drop(hit)


def _best(index: dict[str, list[Rule]], spark) -> Column:
    """The longest fitting rule as a struct. The index is an array of small arrays of rules; a token's hash is its place there. A URL
    takes the rules filed under its own tokens from it, and only their regular expressions are run."""
    kind = "struct<n:int,rule:string,verdict:string>"
    if not index:
        return F.lit(None).cast(kind)
    tokens = sorted(index)
    places = 1 << max(1, (2 * len(tokens)).bit_length())
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(places)).cast("int")
    at = spark.range(1).select(F.array(*[place(F.lit(t)) for t in tokens]).alias("at")).first()["at"]
    filed: list[list] = [[] for _ in range(places)]
    for t, k in zip(tokens, at):
        filed[k] += [F.struct(F.lit(t).alias("token"), F.lit(r.regex).alias("regex"), F.lit(len(r.pattern)).alias("n"), F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in index[t]]
    none = F.array().cast("array<struct<token:string,regex:string,n:int,rule:string,verdict:string>>")
    table = F.array(*[F.array(*x) if x else none for x in filed])
    fetched = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.filter(F.element_at(table, place(t) + 1), lambda r: r["token"] == t)))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _joined(urls: DataFrame, index: dict[str, list[Rule]], hit: str) -> DataFrame:
    filed = [(t, r.regex, len(r.pattern), r.pattern, r.verdict) for t, rs in index.items() for r in rs]
    filed = urls.sparkSession.createDataFrame(filed, "token string, regex string, n int, rule string, verdict string")
    each = urls.select("host", "path").distinct()
    asked = each.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    fits = asked.join(filed, "token").where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("n", "rule", "verdict")).alias(hit))
    return urls.join(best, ["host", "path"], "left").select(*[urls[f"`{c}`"] for c in urls.columns], hit)
