"""URL filters: pattern rules found by their rarest literal token.

Every rule is a regular expression over the url, with literal tokens that any matching url
must contain, bounded on both sides. Rules are indexed by the token that the fewest urls have. The
tokens of a url fetch candidate rules from the index, and only those candidates run their expression.
A rule without such a token runs over all urls.

Edge cases: a null url, or one without ``://``, has empty host and path and is judged by the
patterns alone (a null url matches none). Repeated urls are judged once and joined back to
every row. An empty rule table allows everything. Other columns pass through.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import lookup

#: (host, path, verdict), fixed by the contract of the query.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: (expression over the lower-cased url, its literal tokens): what blocks a url no host rule fits. Only
#: words that stand as whole tokens in every match are listed; before pills and after php more may follow.
PATTERNS = [
    (r"://([^/?#]*[.-])?(casino|bets|poker)[.-]", ["casino|bets|poker"]),
    (r"://([^/?#]*[.-])?cheap-[a-z]+[.]", ["cheap"]),
    (r"://([^/?#]*[.-])?[a-z]*-?pills[.-]", []),
    (r"://([^/?#]*[.-])?adult-[a-z]+[.]", ["adult"]),
    (r"[?&]replytocom=[0-9]+", ["replytocom"]),
    (r"[?&](phpsessid|jsessionid)=", ["phpsessid|jsessionid"]),
    (r"/wp-login[.]php", ["wp", "login"]),
]
TOKEN = "[a-z0-9]+"


def host_of(url):
    """Host of a url: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(rule, verdict, length, tokens, pattern, on_host, way): one row per rule and way to match it.

    ``tokens`` are whole tokens of every match, none if there is no such token. A rule whose literal is one
    of several words has a row for each word. Host rules run over host and path, patterns over the lower-cased url.
    """
    rows = []
    for host, path, verdict in host_rules:
        tokens = re.findall(TOKEN, host) + re.findall(f"(?<=/){TOKEN}(?=/)", path)
        pattern = r"^(?:[^/]*[.])?" + re.escape(host) + re.escape(path)
        rows.append((host + path, verdict, len(host + path), tokens, pattern, True, 0))
    for pattern, literals in patterns:
        first, rest = (literals or [""])[0].split("|"), [x for x in literals[1:] if "|" not in x]
        rows += [
            (pattern, "block", -1, [word, *rest], pattern, False, way) for way, word in enumerate(first)
        ]
    return lookup(
        spark,
        ["rule", "verdict", "length", "tokens", "pattern", "on_host", "way"],
        [(a, b, c, " ".join(d), e, str(f), g) for a, b, c, d, e, f, g in rows],
    ).withColumns({"tokens": F.array_remove(F.split("tokens", " "), ""), "on_host": F.col("on_host") == "True"})


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest host rule that fits decides. Without one the url is blocked if any pattern
    matches (column ``pattern`` has the first by text), else allowed.
    """
    made = ("host", "path", "rule", "verdict", "pattern")
    urls = pages.where(F.col("url").isNotNull()).select(F.col("url").alias("_url")).distinct()
    lower = F.lower("_url")
    tokens = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TOKEN})"), F.lit(1)))
    url_tokens = urls.select("_url", F.explode(tokens).alias("_token"))

    # How many urls have each token of the rules; a token that none has is the rarest.
    wanted = rules.select(F.explode("tokens").alias("_token")).distinct()
    seen = url_tokens.join(wanted, "_token").groupBy("_token").count()
    each = rules.select("*", F.explode("tokens").alias("_token")).join(seen, "_token", "left")
    rarest = F.min_by("_token", F.struct(F.coalesce("count", F.lit(0)), "_token"))
    index = each.groupBy("rule", "way", "verdict", "length", "pattern", "on_host").agg(rarest.alias("_token"))

    over = F.when(F.col("on_host"), F.concat(host_of(F.col("_url")), path_of(F.col("_url")))).otherwise(lower)
    fitting = F.rlike(over, F.col("pattern"))
    ruled = ["_url", "rule", "length", "verdict"]
    found = url_tokens.join(index, "_token").where(fitting).select(*ruled)
    found = found.union(urls.join(rules.where(F.size("tokens") == 0), fitting).select(*ruled))
    best = F.when(F.col("length") >= 0, F.struct("length", "rule", "verdict"))
    verdicts = found.groupBy("_url").agg(
        F.max(best).alias("_best"), F.min(F.when(F.col("length") < 0, F.col("rule"))).alias("_pattern")
    )
    blocked = F.when(F.col("_pattern").isNotNull(), "block").otherwise("allow")
    return (
        pages.drop(*made)
        .join(verdicts, F.col("url") == F.col("_url"), "left")
        .withColumns({
            "host": host_of(F.col("url")),
            "path": path_of(F.col("url")),
            "rule": F.col("_best.rule"),
            "verdict": F.coalesce(F.col("_best.verdict"), blocked),
            "pattern": F.col("_pattern"),
        })
        .drop("_url", "_best", "_pattern")
    )
