"""URL filter: path rules, then exact host membership by a cascade of Bloom filters.

Level one encodes the listed keys, level two those other keys of the universe that level
one lets through, level three the listed keys that level two lets through, and so on
until nothing false is left. A key of the universe is listed if the first level that
does not hold it is an even one. DataFrame functions only; filters reach the rows as
scalar subqueries, so no row is joined.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import write_stage

KEY_BITS = 10  # filter bits per key
HASHES = 7
MAX_BITS = 1 << 24  # of one filter: 2 MiB, whatever the number of listed keys


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null urls and urls without ``://``."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")),
                             F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0),
                       string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule ``host/path-prefix`` that fits, else null."""
    hits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        site, cut, start = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(
            path, F.lit(cut + start))
        hits.append(F.when(fits, F.struct(F.lit(rule).alias("rule"),
                                          F.lit(verdict).alias("verdict"))))
    return F.coalesce(*hits)


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _filter(keys: DataFrame, n: int, level: int) -> tuple[int, Column]:
    """(bits, array of 64-bit words as a scalar subquery) of a Bloom filter over ``key``."""
    bits = 1 << max(10, (KEY_BITS * n - 1).bit_length())
    spark = keys.sparkSession
    ones = (keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
            .select(F.expr("p div 64").alias("w"),
                    F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")))
    words = (ones.union(spark.range(bits // 64).select("id", F.lit(0).cast("long")))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))),
                                lambda x: x["b"]).alias("words"))
    return bits, write_stage(row, f"filter{level}").scalar()


def _holds(key: Column, level: int, made: tuple[int, Column]) -> Column:
    bits, words = made
    return reduce(Column.__and__, [
        F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        for p in _places(key, level, bits)])


def cascade(listed: DataFrame, universe: DataFrame) -> list[tuple[int, Column]]:
    """Filters of all levels; both tables have distinct keys ``key``, listed within universe.

    Each level holds a small share of the level two above, so a few levels end it. No
    listed key: no level. Null keys are never listed.
    """
    n = listed.count()
    inside, outside, levels = listed, None, []
    while n:
        made = _filter(inside, n, len(levels))
        level = len(levels)
        levels.append(made)
        if outside is None:
            # 'key' may be null in neither: nulls were left out before
            outside = universe.join(listed, "key", "left_anti")
        wrong = write_stage(outside.where(_holds(F.col("key"), level, made)), f"level{level}")
        inside, outside, n = wrong, inside, wrong.count()
    return levels


def member(key: Column, levels: list[tuple[int, Column]]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(False)
    for level in reversed(range(len(levels))):
        out = _holds(key, level, levels[level]) & ~out
    return F.coalesce(out, F.lit(False))


def with_membership(rows: DataFrame, key_col: str, listed: DataFrame, out: str,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with boolean ``out``: is the key among ``listed`` (key, distinct)?

    The universe is every key of ``rows``. More listed keys than one filter of
    ``max_bits`` takes are dealt by hash into passes over the rows, each with a cascade
    of its own and written before the next, so no filter grows with the data.
    """
    universe = write_stage(rows.select(F.col(key_col).alias("key")).where("key IS NOT NULL")
                           .distinct(), "universe")
    listed = write_stage(listed.join(universe, "key", "left_semi"), "listed")
    passes = -(-listed.count() * KEY_BITS // max_bits) or 1
    if passes == 1:
        return rows.withColumn(out, member(F.col(key_col), cascade(listed, universe)))
    parts = []
    for k in range(passes):
        own = lambda c: F.pmod(F.xxhash64(c, F.lit("pass")), F.lit(passes)) == k  # noqa: B023,E731
        levels = cascade(listed.where(own(F.col("key"))), universe.where(own(F.col("key"))))
        parts.append(write_stage(rows.where(own(F.col(key_col))).withColumn(
            out, member(F.col(key_col), levels)), f"pass{k}"))
    return reduce(DataFrame.union, parts)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], spam_words: list[str],
               id_col: str = "page_id", url_col: str = "url",
               max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) of each page.

    A host is listed if one of its labels, cut at dots and hyphens, is a spam word; the
    list is drawn from the pages themselves. The longest path rule that fits decides,
    else a listed host is blocked and any other allowed. Null urls have an empty host
    and path and are allowed; repeated rows stay repeated.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    words = F.array(*map(F.lit, spam_words))
    listed = (rows.where(F.arrays_overlap(F.split("host", "[.-]"), words))
              .select(F.col("host").alias("key")).distinct())
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    return (with_membership(rows, "host", listed, "listed", max_bits)
            .withColumn("hit", hit)
            .select(id_col, "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce("hit.verdict", F.when(F.col("listed"), F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict")))
