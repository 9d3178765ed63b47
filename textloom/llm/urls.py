"""URL filters: host and path rules, and a blocked Bloom filter over listed URLs.

Only DataFrame functions. A canonical URL is lower-cased host plus path, without
scheme, query, fragment and final slash. The listed URLs fill a Bloom filter of
``blocks`` blocks of 256 bits: a URL's hash chooses one block and eight bits in it,
so a probe touches one block. The filter has at most ``MAX_BLOCKS`` blocks (a bound
of 32 MB, which is what is broadcast), enough for 12 million listed URLs at about one
false hit in a thousand; a longer list makes more false hits pass to the exact join,
never fewer true ones, and changes no result. What passes is joined exactly with the
listed URLs by hash and text, which removes all false hits.

Null URL, or one without "://": host and path are empty; it fits no rule and is not
listed. Rules are few (a parameter, not data) and become one expression. A repeated
page gives a repeated row. Empty tables give empty results; an empty list of URLs
lets every page pass. Of two rules that fit, the longer wins; URLs of any length work.
Further columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
BITS = 8
#: Of 32 bytes each, so that at most 32 MB are broadcast.
MAX_BLOCKS = 1 << 20
PER_BLOCK = 12


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_replace(path, r"/+\z", ""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The bits of a key as WORDS longs: eight values of a second hash, one byte each."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(second, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(BITS)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for b in bits:
            one = F.expr("1L")
            mask = mask.bitwiseOR(F.when(F.floor(b / 64) == w, F.call_function("shiftleft", one, b % 64)).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom_blocks(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter's blocks that hold a bit: bf_block, bf_0 .. bf_3; at most ``blocks`` rows."""
    key = F.col(column)
    rows = listed.select(_block(key, blocks).alias("bf_block"), *(m.alias(f"bf_{w}") for w, m in enumerate(_masks(key))))
    return rows.groupBy("bf_block").agg(*(F.bit_or(f"bf_{w}").alias(f"bf_{w}") for w in range(WORDS)))


def listed_flag(pages: DataFrame, key: str, listed: DataFrame, listed_key: str, blocks: int | None = None) -> DataFrame:
    """pages with a boolean ``is_listed``: whether its key is among the listed ones."""
    keys = listed.select(F.col(listed_key).alias("bf_key")).filter("bf_key is not null and bf_key != ''").distinct()
    if blocks is None:
        blocks = min(MAX_BLOCKS, max(16, -(-keys.count() // PER_BLOCK)))
    if blocks > MAX_BLOCKS:
        raise ValueError("the filter is broadcast and bounded to MAX_BLOCKS blocks")
    bloom = bloom_blocks(keys, "bf_key", blocks)
    probed = pages.join(F.broadcast(bloom), _block(F.col(key), blocks) == F.col("bf_block"), "left")
    hit = F.lit(True)
    for w, mask in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"bf_{w}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("bf_hit", F.coalesce(hit, F.lit(False))).drop("bf_block", *(f"bf_{w}" for w in range(WORDS)))
    # only distinct possible hits meet the list, and only they come back
    sure = probed.filter("bf_hit").select(F.col(key).alias("bf_key")).distinct().join(keys, "bf_key", "left_semi").withColumn("bf_sure", F.lit(True))
    out = probed.join(sure, F.when(F.col("bf_hit"), F.col(key)) == F.col("bf_key"), "left")
    return out.withColumn("is_listed", F.coalesce("bf_sure", F.lit(False))).drop("bf_key", "bf_sure", "bf_hit")


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_url: str = "url", blocks: int | None = None) -> DataFrame:
    """page id, host, path, rule, verdict, is_listed for every page."""
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("key", canonical(F.col("host"), F.col("path"))).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    bad = listed.select(F.col(listed_url).alias("url")).select(canonical(host_of(url), path_of(url)).alias("key"))
    flagged = listed_flag(own, "key", bad, "key", blocks)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("is_listed"), "block").otherwise("allow"))
    return flagged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "is_listed")
