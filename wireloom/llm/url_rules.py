"""URL filtering by host and path rules.

Each rule is filed under the rarest of its literal tokens. A URL is cut into tokens, the tokens fetch the rules filed
under them, and only those rules' regular expressions run. Everything is a row-local expression: no shuffle, no join. The index
is one literal of the plan, a table of buckets by the token's CRC-32, so a token is looked up in a bucket of about one token
however many rules there are.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule, so it gets the
default verdict. Rows stay as they are given, repeated ones too. Extra columns are not read. Among fitting rules of
equal length the smaller rule string wins. The index travels with the plan, some hundred bytes for each rule.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these characters are tokens; a host's dots and a path's punctuation stand between them.
TOKEN = "[^.:/?#&=_~%+-]+"


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Matches the start of host + path."""
        literal = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in self.text)
        end = "" if self.path else "(?![^/])"
        return rf"^(?:[^/]*\.)?{literal}{end}"

    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole; the last of a path may go on in the URL and doesn't count."""
        path = re.findall(TOKEN, self.path)
        if path and self.path.endswith(path[-1]):
            path = path[:-1]
        return re.findall(TOKEN, self.host) + path


def rule(verdict: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def index_rules(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token among all rules; rules without a token stand under the empty one."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        rarest = min(r.tokens(), key=lambda t: (seen[t], -len(t), t), default="")
        index.setdefault(rarest, []).append(r)
    return index


BUCKETS = "buckets array<array<struct<token:string,length:int,text:string,verdict:string,pattern:string>>>"


def bucket_table(index: dict[str, list[Rule]]) -> list[list[dict]]:
    """As many buckets as tokens; each rule stands in that of its token's CRC-32."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(index)))]
    for token, filed in index.items():
        own = buckets[zlib.crc32(token.encode()) % len(buckets)]
        own += [
            {"token": token, "length": len(r.text), "text": r.text, "verdict": r.verdict, "pattern": r.pattern} for r in filed
        ]
    return buckets


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict; columns of these names are replaced."""
    address = F.concat("_host", "_path")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(address, F.lit(f"({TOKEN})"), F.lit(1))))
    buckets = bucket_table(index_rules(rules))
    # parsed once, when the plan is made
    table = F.from_json(F.lit(json.dumps({"buckets": buckets})), BUCKETS)["buckets"]

    def filed_under(token: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(token.cast("binary")), F.lit(len(buckets))).cast("int"))
        return F.filter(bucket, lambda r: r["token"] == token)

    fetched = F.flatten(F.transform(tokens, filed_under))
    fitting = F.filter(fetched, lambda r: F.rlike(F.concat("_host", "_path"), r["pattern"]))
    ranked = F.array_sort(fitting, lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
                          .when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_host", "_path", "_rule")]
    return (
        pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
        .withColumn("_rule", F.get(ranked, F.lit(0)))
        .select(
            *[F.col(f"`{c}`") for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"),
            F.col("_rule.text").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"),
        )
    )
