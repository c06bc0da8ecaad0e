"""URL filters over a Bloom filter cascade.

A rule or a block list names keys: a host with an optional path prefix. Every
URL gives candidate keys (its host's suffixes, with the path prefixes of the
lengths that rules have). All candidates of the corpus are the *complete key
universe*. The cascade answers "is this key listed?" exactly for every key of
that universe, without a join: level 0 is a Bloom filter of the listed keys, level 1
one of the unlisted keys that level 0 lets through, level 2 one of the listed
keys that level 1 lets through, and so on until a level lets nothing through.
A key is listed if the first level that refuses it is odd.

Building is distributed: the universe is a distinct over hashed keys (combined
before the shuffle, so a host with a third of all pages is one row per
partition), bits are set by a grouped ``bit_or`` over words, and each level
shrinks the sets geometrically. Only the filters reach the driver. Their size
follows from the number of listed keys and is computed from counts first;
beyond ``max_filter_bytes`` the keys are split into shards by hash and the
pages are probed shard by shard, each pass with one bounded broadcast.

Defined results: a null URL or one without ``://`` has an empty host and path and no
candidates, so it is allowed; equal URLs get equal verdicts; an empty table or
an empty list gives an empty or an all-allow result. Of rules that fit, the
longest wins (a tie goes to the longer host). A long URL is one row like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str    # fits the host itself and all its subdomains
    path: str    # the URL's path starts with it

    @property
    def text(self) -> str:
        return self.host + self.path


#: The fixed rules of the registered query.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)
#: A host with one of these words as a label, or as a part of one between hyphens, is on the corpus's block list.
SPAM_WORDS = ("spam", "pills", "casino", "bets", "adult", "ads")

#: Kinds of keys; a key is hashed with its kind, so one cascade serves all.
ALLOW, BLOCK, LISTED = "a", "b", "l"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path`` of the URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (pages.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER))
            .withColumn("path", F.regexp_extract(url, pattern, 2)))


def candidates(host: Column, path: Column, rules: tuple[Rule, ...], with_list: bool) -> Column:
    """Array of (kind, key, path_length) that a URL can match."""
    labels = F.split(host, r"\.")
    # Suffixes of the host at label borders, the whole host first.
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = []
    for action, kind in (("allow", ALLOW), ("block", BLOCK)):
        # Prefixes of the lengths that rules of the action have.
        for n in sorted({len(r.path) for r in rules if r.action == action}):
            prefix = F.substring(path, 1, n)
            keys = _keyed(suffixes, kind, prefix, n)
            parts.append(F.when(F.length(path) >= n, keys).otherwise(F.array().cast(CANDIDATE)))
    if with_list:
        parts.append(_keyed(suffixes, LISTED, F.lit(""), 0))
    if not parts:
        return F.array().cast(CANDIDATE)
    return F.concat(*[p.cast(CANDIDATE) for p in parts])


def _keyed(suffixes: Column, kind: str, prefix: Column, n: int) -> Column:
    return F.transform(suffixes, lambda s: F.struct(
        F.lit(kind).alias("kind"), F.concat(s, prefix).alias("key"), F.lit(n).alias("path_length")))


CANDIDATE = "array<struct<kind:string,key:string,path_length:int>>"


def _hashes(kind: Column, key: Column) -> tuple[Column, Column]:
    return F.xxhash64(kind, key), F.xxhash64(F.lit("second"), key, kind)


@dataclass
class Level:
    n_bits: int
    n_hashes: int
    words: np.ndarray  # uint64


def _positions(one: np.ndarray, two: np.ndarray, level: int, j: int, n_bits: int) -> np.ndarray:
    step = np.uint64(2 * (64 * level + j) + 1)
    with np.errstate(over="ignore"):
        mixed = one.view(np.uint64) + step * two.view(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)) % np.uint64(n_bits)


def passes(level_no: int, level: Level, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    ok = np.ones(len(one), dtype=bool)
    for j in range(level.n_hashes):
        at = _positions(one, two, level_no, j, level.n_bits)
        ok &= (level.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def member(levels: list[Level], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe."""
    out = np.zeros(len(one), dtype=bool)
    still = np.arange(len(one))
    for i, level in enumerate(levels):
        ok = passes(i, level, one[still], two[still])
        out[still[~ok]] = i % 2 == 1
        still = still[ok]
    out[still] = len(levels) % 2 == 1  # through every level: as the last set encoded
    return out


def level_size(n_keys: int, rate: float) -> tuple[int, int]:
    """(bits, hash functions) of a Bloom filter for a false-positive rate."""
    bits = max(64, math.ceil(n_keys * -math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def first_rate(n_listed: int, n_unlisted: int) -> float:
    """Rate of level 0 that leaves about 0.7 unlisted keys for each listed one; later levels use one half."""
    return min(0.5, max(1e-9, n_listed * math.sqrt(0.5) / max(1, n_unlisted)))


def _encode(keys: DataFrame, level: int, n_keys: int, rate: float) -> Level:
    """Bloom filter of ``keys`` (one, two): each task sets its bits, words are then merged by ``bit_or``."""
    n_bits, n_hashes = level_size(n_keys, rate)

    def bits(batches):
        for batch in batches:
            one, two = batch["one"].to_numpy(np.int64), batch["two"].to_numpy(np.int64)
            at = np.concatenate([_positions(one, two, level, j, n_bits) for j in range(n_hashes)])
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            where, first = np.unique(word[order], return_index=True)
            if len(where):
                yield pd.DataFrame({"word": where.astype(np.int64), "bits": np.bitwise_or.reduceat(bit[order], first).view(np.int64)})
    rows = keys.select("one", "two").mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = rows.toPandas()  # at most n_bits / 64 words: within the checked bound
    words = np.zeros(n_bits // 64, dtype=np.uint64)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(n_bits, n_hashes, words)


def _through(held: Broadcast, no: int) -> Callable:
    @F.pandas_udf("boolean")
    def through(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(passes(no, held.value, one.to_numpy(np.int64), two.to_numpy(np.int64)))
    return through


def build_cascade(universe: DataFrame, max_levels: int = 60) -> list[Level]:
    """Levels for a universe of distinct (one, two, listed)."""
    spark = universe.sparkSession
    n = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    inside, outside = universe.where("listed"), universe.where(~F.col("listed"))
    n_in, n_out = n.get(True, 0), n.get(False, 0)
    levels: list[Level] = []
    while n_in:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end: two keys share both hashes")
        rate = first_rate(n_in, n_out) if not levels else 0.5
        levels.append(_encode(inside, len(levels), n_in, rate))
        through = _through(spark.sparkContext.broadcast(levels[-1]), len(levels) - 1)
        # Those of the other side that this level lets through are what the next one encodes.
        wrong = saved(outside.where(through("one", "two")), "url_level")
        outside, inside, n_in = inside, wrong, wrong.count()
    return levels


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, block_hosts: DataFrame | None = None,
                url_col: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with host, path, rule (text of the one that fits, else null), verdict and listed.

    Columns of these names that the pages have are replaced.

    ``block_hosts`` is a table of hosts (column ``host``) that are blocked, with
    their subdomains, where no rule fits.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    page = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_page"), F.col(f"`{url_col}`").alias("_url"))
    parts = with_parts(page, "_url").drop("_url")
    has_list = block_hosts is not None
    cands = parts.withColumn("_c", candidates(F.col("host"), F.col("path"), rules, has_list))
    universe = _universe(spark, cands, rules, block_hosts)

    n_listed, n_all = universe.agg(F.count_if("listed"), F.count("*")).first()
    # All levels together take less than twice the bits of the first two.
    bits = 2 * (level_size(n_listed, first_rate(n_listed, n_all - n_listed))[0] + level_size(n_listed, 0.5)[0])
    n_shards = max(1, -(-bits // (8 * max_filter_bytes)))
    hits = F.array().cast("array<boolean>")
    cands = cands.withColumn("_hit", hits)
    for shard in range(n_shards):
        of_shard = universe.where(F.pmod("one", F.lit(n_shards)) == shard) if n_shards > 1 else universe
        cands = _probe(spark, cands, build_cascade(of_shard), shard, n_shards)
        if n_shards > 1:
            cands = saved(cands, "url_probe")  # one filter at a time is held
    return _verdicts(cands)


def _universe(spark: SparkSession, cands: DataFrame, rules: tuple[Rule, ...], block_hosts: DataFrame | None) -> DataFrame:
    """Distinct (one, two, listed) over every candidate key of the corpus."""
    keys = cands.select(F.explode("_c").alias("c")).select("c.kind", "c.key").distinct()
    listed = spark.createDataFrame([(ALLOW if r.action == "allow" else BLOCK, r.text) for r in rules], "kind string, key string")
    if block_hosts is not None:
        listed = listed.unionByName(block_hosts.select(F.lit(LISTED).alias("kind"), F.translate(
            F.col("host").cast("string"), UPPER, LOWER).alias("key")).where("key IS NOT NULL"))
    listed = listed.distinct().withColumn("listed", F.lit(True))
    one, two = _hashes(F.col("kind"), F.col("key"))
    return saved(keys.join(listed, ["kind", "key"], "left").select(
        one.alias("one"), two.alias("two"), F.coalesce("listed", F.lit(False)).alias("listed")), "url_universe")


def _probe(spark: SparkSession, cands: DataFrame, levels: list[Level], shard: int, n_shards: int) -> DataFrame:
    held = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def hit(one: pd.Series, two: pd.Series, before: pd.Series) -> pd.Series:
        sizes = one.map(len).to_numpy()
        if not sizes.sum():
            return before
        ones, twos = np.concatenate(one.to_list()), np.concatenate(two.to_list())
        found = member(held.value, ones.astype(np.int64), twos.astype(np.int64))
        if n_shards > 1:
            found &= np.mod(ones.astype(np.int64), n_shards) == shard
        cuts = np.split(found, np.cumsum(sizes)[:-1])
        if shard:
            cuts = [c | np.asarray(b, dtype=bool) for c, b in zip(cuts, before, strict=True)]
        return pd.Series(cuts)
    one = F.transform("_c", lambda c: _hashes(c["kind"], c["key"])[0])
    two = F.transform("_c", lambda c: _hashes(c["kind"], c["key"])[1])
    return cands.withColumn("_hit", hit(one, two, F.col("_hit")))


def _verdicts(cands: DataFrame) -> DataFrame:
    found = F.filter("_c", lambda c, i: F.coalesce(F.get("_hit", i), F.lit(False)))
    fits = F.transform(F.filter(found, lambda c: c["kind"] != LISTED), lambda c: F.struct(
        F.length(c["key"]).alias("length"), (-c["path_length"]).alias("host_first"), c["key"].alias("key"), c["kind"].alias("kind")))
    out = cands.withColumn("_rule", F.array_max(fits)).withColumn("_listed", F.exists(found, lambda c: c["kind"] == LISTED))
    action = F.when(F.col("_rule")["kind"] == ALLOW, "allow").when(F.col("_rule")["kind"] == BLOCK, "block")
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return out.select("_page.*", "host", "path", F.col("_rule")["key"].alias("rule"),
                      F.coalesce(action, method).alias("verdict"), F.col("_listed").alias("listed"))


def spam_hosts(pages: DataFrame, url_col: str = "url", words: tuple[str, ...] = SPAM_WORDS) -> DataFrame:
    """The corpus's block list: distinct hosts that name what they sell."""
    pattern = rf"(^|[.-])({'|'.join(words)})([.-]|$)"
    return with_parts(pages, url_col).select("host").where(F.col("host").rlike(pattern)).distinct()
