"""URL filters: blocked Bloom filters before exact hash joins.

A list of URL rules or of whole canonical URLs may be far larger than memory.
Its keys set bits in a Bloom filter of fixed greatest size, made of blocks of
eight 32-bit words: a key sets one bit in each word of one block. The blocks
are summed up with `bit_or` on the executors; only that filter, whose size is
bounded, is broadcast. Keys that pass are joined exactly with the list, so that
false positives go. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.tables import settled, whole_row

#: Blocks of 256 bits: at most 65,536 * 32 bytes = 2 MB are broadcast.
MAX_BLOCKS = 1 << 16
#: Odd multipliers, one for each word of a block (fixed values).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#`; A-Z in
    lower case. Empty for null and for texts without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without user and default port, path and query; no scheme or
    fragment. Other spellings of an address have the same canonical URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:80|:443)?$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query)


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and the bit it sets in each of the eight words."""
    h = F.xxhash64(key)
    # 30 bits, so that the products stay within 64 bits.
    low = h.bitwiseAND(F.lit((1 << 30) - 1))
    block = F.pmod(F.shiftright(h, 32), F.lit(blocks)).cast("int")
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, F.shiftright(low * F.lit(s), 25).bitwiseAND(F.lit(31)).cast("int")) for s in SALTS]
    return [block, *words]


def bloom_blocks(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The blocks of a Bloom filter with all keys: (block, w0 to w7), at most
    `max_blocks` rows however many keys there are. More keys let more false
    positives through; the exact join removes them. Null keys set no bit."""
    block, *words = _bits(F.col(key), max_blocks)
    return (
        keys.where(F.col(key).isNotNull())
        .select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))])
    )


def possible(rows: DataFrame, key: str, blocks: DataFrame, max_blocks: int = MAX_BLOCKS, without: bool = False) -> DataFrame:
    """The rows whose key may be in the filter; `without`: those whose key is
    surely not."""
    block, *words = _bits(F.col(key), max_blocks)
    mine = rows.select(whole_row(rows), block.alias("at"), *[w.alias(f"b{i}") for i, w in enumerate(words)])
    hit = mine["at"] == blocks["block"]
    for i in range(len(SALTS)):
        hit = hit & (blocks[f"w{i}"].bitwiseAND(mine[f"b{i}"]) != 0)
    # Its size is bounded by max_blocks rows of nine numbers.
    return mine.join(F.broadcast(blocks), hit, "left_anti" if without else "left_semi").select("row.*")


def listed(rows: DataFrame, key: str, keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key is in `keys` (one column of that name), exactly:
    Bloom filter, then a hash join. Rows keep their repeats, nulls never match."""
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return possible(rows, key, bloom_blocks(keys, key, max_blocks), max_blocks).join(keys, key, "left_semi")


def not_listed(rows: DataFrame, key: str, keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key is not in `keys` (nulls never are), exactly. Rows that
    the filter clears are not shuffled."""
    keys = settled(keys.select(key).where(F.col(key).isNotNull()).distinct(), "listed")
    blocks = bloom_blocks(keys, key, max_blocks)
    near = possible(rows, key, blocks, max_blocks)
    left = near.select(whole_row(near), F.col(key).alias("key")).join(keys.select(F.col(key).alias("key")), "key", "left_anti").select("row.*")
    return possible(rows, key, blocks, max_blocks, without=True).unionByName(left)


def match_rules(urls: DataFrame, rules: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(url, rule, action) of the longest rule that fits each distinct url.

    `urls` has url, host, path; `rules` has host, path, action. A rule fits its
    host and all subdomains if the path starts with the rule's path. The longest
    rule text wins (equal ones: the smaller text, then action). An url without
    a fitting rule has no row. Possible rules of an url are its host's suffixes
    times its path's prefixes, of the lengths that the rules' paths have.
    """
    keyed = rules.select(F.concat("host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("rule"), "action").where(F.col("key").isNotNull()).distinct()
    # At most as many numbers as the longest path has characters.
    lengths = rules.select(F.length("path").alias("n")).where(F.col("n").isNotNull()).groupBy().agg(F.sort_array(F.collect_set("n"))).scalar()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("length", F.explode(lengths))
        .where(F.col("length") <= F.length("path"))
        .select("url", F.concat("suffix", F.lit(" "), F.substring(F.col("path"), F.lit(1), F.col("length"))).alias("key"))
    )
    near = possible(tried, "key", bloom_blocks(keyed, "key", max_blocks), max_blocks)
    best = F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), F.col("rule"), F.col("action")))
    return near.join(keyed, "key").groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, blocklist: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """id, url, host, path, rule, listed (boolean), verdict of every row.

    A rule's action is the verdict where a rule fits. Elsewhere an url is
    blocked if its canonical URL is listed: in `blocklist` (a column
    `canonical`), or the canonical URL of an url that a rule blocks, in another
    spelling. Each distinct url is judged once, so a hot url or host costs no
    more than one row; null and empty urls are one url with empty host and
    path. Repeated rows stay; no row is lost. Empty tables give empty results.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    rows = pages.select(F.col(id_column).alias("_id"), url.alias("url"), F.col(url_column).isNull().alias("_null"))
    urls = rows.select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "canonical": canonical_url(F.col("url"))})
    ruled = urls.join(match_rules(urls, rules, max_blocks), "url", "left")
    blocked = ruled.where(F.col("action") == "block").select("canonical")
    if blocklist is not None:
        blocked = blocked.unionByName(blocklist.select("canonical"))
    free = ruled.where(F.col("rule").isNull() & (F.col("host") != "")).select("url", "canonical")
    hits = listed(free, "canonical", blocked, max_blocks).select("url", F.lit(True).alias("_listed"))
    judged = settled(ruled.join(hits, "url", "left").select(
        "url", "host", "path", "rule", F.coalesce("_listed", F.lit(False)).alias("listed"),
        F.coalesce("action", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    ), "urls")
    return rows.join(judged, "url").select(F.col("_id").alias(id_column), F.when(~F.col("_null"), F.col("url")).alias(url_column), "host", "path", "rule", "listed", "verdict")
