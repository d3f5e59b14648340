"""URL filter: pattern rules are indexed under their rarest literal token, the tokens of a URL fetch candidate rules, and
only those run their regular expression.

All of it is column expressions over the rows: the index is a constant of hash buckets, sized by the rules, so there is no
shuffle and no broadcast of data."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path, put together. ``literals`` are whole tokens (runs of a-z and 0-9 after
    lower-casing) that every matching URL holds. Site rules come before others; among them the longest name wins, then block."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...] = ()
    site: bool = False


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def site_rule(action: str, site: str) -> Rule:
    """A host with all its subdomains, and the beginning of a path, as in ``example.net/en/``."""
    host, slash, rest = site.partition("/")
    path = slash + rest
    whole = f"{host}{path}".lower()
    tokens = re.findall(r"[a-z0-9]+", whole)
    if tokens and re.search(r"[a-z0-9]\Z", whole):  # the last token may go on in a URL
        tokens.pop()
    return Rule(site, action, rf"\A(?:[^/]*\.)?{quoted(host)}{quoted(path)}", tuple(dict.fromkeys(tokens)), True)


#: Sites of the given list.
SITES = (site_rule(BLOCK, "net/"), site_rule(ALLOW, "example.net/en/"), site_rule(BLOCK, "example.com/de/"), site_rule(ALLOW, "org/fr/"))

#: Patterns of addresses that carry no text worth keeping. What none of them fits is allowed.
PATTERNS = (
    Rule("spam farm", BLOCK, r"\A[^/]*spam-farm[.:-]?", ("spam", "farm")),
    Rule("link farm", BLOCK, r"\A[^/]*link-farm[.:-]?", ("link", "farm")),
    Rule("casino", BLOCK, r"\A(?:[^/]*[.-])?casino[.-]", ("casino",)),
    Rule("poker", BLOCK, r"\A(?:[^/]*[.-])?poker[.-]", ("poker",)),
    Rule("adult", BLOCK, r"\A(?:[^/]*[.-])?(?:xxx|porn)[.-]", ()),
    Rule("ad server", BLOCK, r"\A(?:[^/]*\.)?ad[sx]?[0-9]*\.[^/]+\.", ()),
    Rule("tracker", BLOCK, r"\A(?:[^/]*\.)?tracker\.", ("tracker",)),
    Rule("login page", BLOCK, r"/login(?:/|\.php|\.html)?\z", ("login",)),
    Rule("cart page", BLOCK, r"/cart/checkout", ("cart",)),
    Rule("session address", BLOCK, r";jsessionid=", ("jsessionid",)),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: null and addresses without ``://`` have neither."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(subject: Column) -> Column:
    """Distinct tokens; the empty token is always among them and fetches the rules without a literal."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+")))


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each literal of the rules stands. The result has at most one row per literal."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    held = F.array_intersect(tokens(F.concat(*parts(F.col(url)))), F.array(*map(F.lit, literals)))
    rows = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {t: 0 for t in literals} | {r["token"]: r["n"] for r in rows}


def index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """The rules in buckets by a hash of their rarest literal, as a constant."""
    from zlib import crc32

    size = 1 << max(2 * len(rules), 4).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        token = min(r.literals, key=lambda t: (counts.get(t, 0), t), default="")
        buckets[crc32(token.encode()) % size].append(
            {"token": token, "name": r.name, "action": r.action, "pattern": r.pattern, "site": r.site})
    kind = "array<array<struct<token: string, name: string, action: string, pattern: string, site: boolean>>>"
    return F.from_json(F.lit(json.dumps(buckets)), kind), size


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule (the site rule that wins, else null), verdict, pattern (another rule that fits, else null) and
    n_candidates (rules whose expression was run).

    A URL without a fitting rule is allowed; so are null and empty ones. Rows and other columns stay as they are; columns
    named like a result are replaced."""
    buckets, size = index(rules, token_counts(pages, rules, url))
    host, path = parts(F.col(url))
    names = ("host", "path", "rule", "verdict", "pattern", "n_candidates")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    found = pages.select(*kept, host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    fetched = F.flatten(F.transform(tokens(subject), lambda t: F.filter(
        F.element_at(buckets, (F.crc32(t.cast("binary")) % size + 1).cast("int")), lambda r: r["token"] == t)))
    found = found.withColumn("_fetched", fetched)
    fits = F.filter("_fetched", lambda r: F.rlike(subject, r["pattern"]))
    ranked = F.transform(fits, lambda r: F.struct(
        r["site"].alias("site"), F.length(r["name"]).alias("size"), (r["action"] == BLOCK).alias("blocks"), r["name"].alias("name"), r["action"].alias("action")))
    found = found.withColumn("_best", F.array_max(ranked))
    return found.select(
        *kept, "host", "path", F.when(F.col("_best.site"), F.col("_best.name")).alias("rule"),
        F.coalesce("_best.action", F.lit(ALLOW)).alias("verdict"), F.when(~F.col("_best.site"), F.col("_best.name")).alias("pattern"),
        F.size("_fetched").cast("long").alias("n_candidates"))
