"""URL filters: rules on hosts and paths, and a list of canonical URLs behind a blocked Bloom filter.

A URL that no rule decides is blocked if its canonical form is listed.  Its hash first meets a blocked Bloom
filter: one block of eight 32-bit words, one bit in each.  The blocks are rows, made by grouped `bit_or`, and
are broadcast after their number is known and within the bound, else joined by shuffling.  What passes is
joined exactly with the list, which removes the filter's false positives; that join is split by Spark where
one URL has very many rows.

Null URLs and those without `://` have an empty host and path, match no rule and aren't listed: they're allowed.
Repeated rows get equal results.  Very long URLs are read whole.  An empty list allows whatever no rule blocks; an empty
table of pages gives an empty result; further columns don't matter.  All runs in Spark's operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small_side, table

#: Verdict and rule.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BITS_PER_URL = 16
#: Odd multipliers, one for each word of a block: from the golden ratio by steps.
SALTS = [(0x9E3779B1 + 2 * k * 0x1F123BB5) % 2**32 | 1 for k in range(8)]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without a final `/` or `.html`, and the sorted query without tracking keys."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(raw, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)="))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def decide(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    choice = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        pick = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, pick) if choice is None else choice.when(fits, pick)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(key, 32), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """For each word, the number of the bit that a key sets."""
    low = key.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of `listed`'s column `url`: a row (block, w0 .. w7) for each block that has a bit."""
    key = F.xxhash64("url")
    words = [F.expr(f"shiftleft(1L, b{k})").alias(f"x{k}") for k in range(8)]
    bits = listed.select(_block(key, blocks).alias("block"), *(b.alias(f"b{k}") for k, b in enumerate(_bits(key))))
    return bits.select("block", *words).groupBy("block").agg(*(F.bit_or(f"x{k}").alias(f"w{k}") for k in range(8)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` and `possible` (the Bloom filter's answer) for every row of `pages`.

    `listed` has a column `url` of canonical URLs.
    """
    spark = pages.sparkSession
    listed = listed.select("url").where(F.col("url").isNotNull()).distinct()
    count = listed.count()
    blocks = max(1, -(-count * BITS_PER_URL // 256))
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumn("chosen", decide(F.col("host"), F.col("path"), RULES if rules is None else rules))
    ruled = seen.where("chosen is not null").select("page_id", "host", "path", "chosen.rule", "chosen.verdict", F.lit(False).alias("possible"))
    key = F.xxhash64("canonical")
    open_ = seen.where("chosen is null").withColumn("block", _block(key, blocks))
    for k, b in enumerate(_bits(key)):
        open_ = open_.withColumn(f"b{k}", b)
    tested = open_.join(small_side(bloom(listed, blocks), blocks, 72), "block", "left")
    all_set = F.lit(True)
    for k in range(8):
        all_set = all_set & (F.expr(f"getbit(w{k}, b{k})") == 1)
    tested = tested.withColumn("possible", F.coalesce(all_set, F.lit(False)))
    none = F.lit(None).cast("string").alias("rule")
    passed = tested.where("not possible").select("page_id", "host", "path", none, F.lit("allow").alias("verdict"), "possible")
    exact = tested.where("possible").join(listed.select(F.col("url").alias("canonical"), F.lit(True).alias("is_listed")).hint("shuffle_hash"), "canonical", "left")
    checked = exact.select("page_id", "host", "path", none, F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict"), "possible")
    return ruled.unionByName(passed).unionByName(checked)


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: canonical URLs of pages whose address says https and whose path ends in `.html`.

    It stands for a bought list: it names a part of the corpus's URLs, in a form other pages' URLs vary.
    """
    return pages.where(F.col("url").rlike(r"^https://[^?#]*\.html$")).select(canonical(F.col("url")).alias("url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: the verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        at, _, rest = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in rules)
    return f"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{az}', '{az.lower()}'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
  list_aggregate(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))), 'string_agg', '&') AS q FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/+)$', '') || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END AS canonical FROM u),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(url, '^https://[^?#]*\\.html$'))
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM c"""


SQL = _sql()
