"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks; a URL sets or tests one bit in each of
the eight words of one block.  It has a fixed greatest size, so it can be
broadcast whatever the length of the list.  URLs that it passes are looked up in
the list itself, by their text; that removes the false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import materialise, packed, unpacked

WORDS = 8  # of 64 bits in a block
BITS_FOR_URL = 12
MOST_BLOCKS = 1 << 17  # 8 MiB: longer lists pass more false positives, which the join removes
#: The rules asked for, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Query parameters that don't name a page.
TRACKING = r"utm_[^=&]*|ref|fbclid|gclid"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking parameters; no scheme, no fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")), "&")
    bare = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) == "", F.lit(None)).when(kept == "", bare).otherwise(F.concat(bare, F.lit("?"), kept))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bit that a URL has in each word."""
    h = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """A row (block, w0 ... w7) for each block with a bit set: ``blocks`` rows at most."""
    bits = listed.select(_block(F.col("canon"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canon")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def url_filter(pages: DataFrame, listed: DataFrame, *, rules=RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Judge the ``url`` of every row of ``pages``; ``listed`` has the canonical URLs to block in ``canon``.

    Columns added: host, path, canon, maybe (the Bloom filter passes it), listed
    (it is on the list), rule, verdict; columns of ``pages`` with these names
    are replaced.  The longest rule that fits decides; without one, a listed URL
    is blocked and any other allowed.  A null URL, or one without ``://``, has an
    empty host and path, no canonical form, and is allowed.  Repeated rows and
    repeated list entries change nothing; an empty list blocks nothing.
    """
    rows = packed(pages, ["host", "path", "canon", "maybe", "listed", "rule", "verdict"], "url")
    known = materialise(listed.select("canon").where("canon is not null").distinct(), "url-list")
    blocks = min(most_blocks, max(1, math.ceil(known.count() * BITS_FOR_URL / (64 * WORDS))))
    bloom = F.broadcast(bloom_filter(known, blocks))  # most_blocks rows of 72 bytes at most
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("canon", canonical(F.col("url")))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    tested = rows.withColumn("_block", _block(F.col("canon"), blocks)).join(bloom.withColumnRenamed("block", "_block"), "_block", "left")
    tested = tested.select(*rows.columns, F.coalesce(hit & F.col("canon").isNotNull(), F.lit(False)).alias("maybe"))
    exact = known.withColumnRenamed("canon", "_canon").hint("shuffle_hash")
    passed = tested.where("maybe").join(exact, F.col("canon") == F.col("_canon"), "left").withColumn("listed", F.col("_canon").isNotNull()).drop("_canon")
    judged = passed.unionByName(tested.where("not maybe").withColumn("listed", F.lit(False)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return unpacked(judged, "host", "path", "canon", "maybe", "listed", rule.alias("rule"), verdict.alias("verdict"))
