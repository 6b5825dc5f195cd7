"""URL filters by hashed expressions.

Each URL is expanded into host-suffix + path-prefix expressions. Their digests' first 32
bits are equi-joined with the rules', the whole SHA-256 digests confirm a hit, and of the
rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest on which expressions and rules are joined.
SHORT = 8
#: Bytes of rules that are broadcast at most, by their measured size; beyond, both sides are shuffled.
BYTES = 16 << 20
#: Between host and path in a digest; neither can hold it, as host and path are parted at a '/'.
BETWEEN = "\x00"


def parts(url):
    """Host and path columns; both empty for null and for a text without '://'."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict.

    `rules` has host, path, verdict. A rule fits its host and that host's subdomains, if
    the URL's path starts with the rule's. The longest host + path wins; of equally long
    ones the longer host, then 'block'. Without a rule, rule is null and verdict is
    `default`. Null or malformed URLs have an empty host and path, which only rules with an
    empty host and path fit. Rules with a null host, path or verdict don't count. Repeated
    pages keep a row each. Only page_id and url are read. Of a page only its expressions that a rule
    fits are gathered. Rules are broadcast if they take BYTES at most; else both sides are shuffled, and
    Spark splits a short prefix that many pages share.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    # numbers of labels and lengths of paths that rules have: what an expression must look like to be able to fit
    labels = sorted(r[0] for r in rules.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    held = rules.select(
        F.concat("r_host", "r_path").alias("rule"),
        "r_verdict",
        F.length("r_host").alias("host_length"),
        F.sha2(F.concat("r_host", F.lit(BETWEEN), "r_path"), 256).alias("r_digest"),
    ).withColumn("short", F.substring("r_digest", 1, SHORT))

    host, path = parts(F.col("url").cast("string"))
    rows = cut(pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host.alias("host"), path.alias("path")), "urls")
    rows = rows.withColumn("labels", F.split("host", r"\.", -1))
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    suffixes = F.transform(
        F.filter(ints(labels), lambda k: k <= F.size("labels")),
        lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."),
    )
    starts = F.transform(F.filter(ints(lengths), lambda k: k <= F.length("path")), lambda k: F.expr("path").substr(F.lit(1), k))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.sha2(F.concat(s, F.lit(BETWEEN), p), 256))))
    rows = rows.select("uid", "page_id", "host", "path", digests.alias("digests"))
    spread = rows.select("uid", F.explode("digests").alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    size = held.agg(F.sum(F.length("rule") + 128)).first()[0] or 0
    fits = spread.join(F.broadcast(held), "short") if size <= BYTES else spread.hint("merge").join(held, "short")
    fits = fits.where("digest = r_digest")
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("r_verdict") == "block").alias("b"), "rule", "r_verdict"))
    best = fits.groupBy("uid").agg(best.alias("best"))
    return rows.join(best, "uid", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
