"""Joins of data onto ids, keys, crosswalks and registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import lookup
from panelspark.functions.text import fold_key, normalise_or_missing
from panelspark.operators.core import require, small_side
from panelspark.session import cut_lineage


def align(ids: DataFrame, values: DataFrame, key: str = "pixel_id") -> DataFrame:
    """Values onto an id table; ids without a value get null."""
    return ids.join(values, key, "left")


def semi(df: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keep.select(*keys).distinct(), list(keys), "left_semi")


def anti(df: DataFrame, drop: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(drop.select(*keys).distinct(), list(keys), "left_anti")


def must_match(df: DataFrame, attrs: DataFrame, keys: Sequence[str],
               columns: Sequence[str]) -> DataFrame:
    """Left join that fails the job when a row finds no partner."""
    marked = attrs.select(*keys, *columns, F.lit(True).alias("__hit"))
    out = df.join(marked, list(keys), "left")
    return require(out, F.col("__hit").isNull(),
                   "rows without attributes").drop("__hit")


def prefixed_join(df: DataFrame, context: DataFrame, keys: Sequence[str],
                  columns: Sequence[str], prefix: str) -> DataFrame:
    """Left join whose right columns are renamed where the names collide."""
    taken = set(df.columns)
    right = context.select(*keys, *[
        F.col(c).alias(f"{prefix}{c}" if c in taken else c) for c in columns])
    return df.join(right, list(keys), "left")


def crosswalk_table(published: DataFrame, alias: DataFrame,
                    origin: str = "published") -> DataFrame:
    """(table, key) -> class. Published rows win over alias rows.

    Priority is an aggregate over (table, key), so it needs no window.
    """
    cols = ["intensity", "method", "record_class"]
    a = published.select(
        "table", F.col("activity_key").alias("key"), *cols,
        F.lit(origin).alias("origin"), F.lit(0).alias("__p"))
    b = alias.select(
        "table", normalise_or_missing(F.col("observed_activity")).alias("key"),
        *cols, F.concat(F.lit("alias_"), "resolution").alias("origin"),
        F.lit(1).alias("__p"))
    both = a.unionByName(b)
    pick = both.groupBy("table", "key").agg(
        F.min(F.struct("__p", *cols, "origin")).alias("__row"))
    return pick.select("table", "key", "__row.*").drop("__p")


def crosswalk_join(records: DataFrame, table: str, crosswalk: DataFrame,
                   key: str = "key_value") -> DataFrame:
    """Class of each record by its normalised activity; unresolved stays null."""
    x = crosswalk.where(F.col("table") == table).drop("table")
    return (records.withColumn("__key", normalise_or_missing(F.col(key)))
            .join(x.withColumnRenamed("key", "__key"), "__key", "left")
            .drop("__key"))


def folded_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str,
                  columns: Sequence[str]) -> DataFrame:
    """Left join on a case and trim insensitive key.

    The table is reduced to one row per folded key first, so a repeated lookup
    row can never multiply the data.
    """
    t = table.groupBy(fold_key(F.col(table_key)).alias("__fk")).agg(
        F.min(F.struct(*columns)).alias("__row")).select("__fk", "__row.*")
    return (df.withColumn("__fk", fold_key(F.col(key)))
            .join(t, "__fk", "left").drop("__fk"))


def label_roles(df: DataFrame, label: str, roles: Mapping[str, str],
                out: str = "role") -> DataFrame:
    return df.withColumn(out, lookup(F.col(label), dict(roles)))


def undeclared_labels(df: DataFrame, label: str,
                      roles: Mapping[str, str]) -> DataFrame:
    """Labels the registry does not know, with their record counts."""
    return (df.where(F.col(label).isNotNull() & ~F.col(label).isin(list(roles)))
            .groupBy(label).agg(F.count(F.lit(1)).alias("n_records")))


def _grams(words: DataFrame) -> DataFrame:
    """(u, g, k): two-letter pieces of each string with its ends marked; k counts repeats."""
    s = F.concat(F.lit("\u0001"), F.col("u"), F.lit("\u0001"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("u") + 1),
                         lambda i: F.substring(s, i, F.lit(2)))
    same = Window.partitionBy("u", "g").orderBy("__at")
    return words.select("u", F.posexplode(pieces).alias("__at", "g")).select(
        "u", "g", F.row_number().over(same).alias("k"))


def _rarest(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Pieces of each string numbered from its rarest on."""
    order = Window.partitionBy("u").orderBy("n", "g", "k")
    return grams.join(counts, ["g", "k"]).select(
        "u", "g", "k", F.length("u").alias("len"), F.row_number().over(order).alias("place"))


def within_distance(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(lu, ru): pairs of strings that may lie within ``radius`` edits; none is missed.

    ``left`` and ``right`` are numbered pieces. One edit spoils two pieces at most, so
    strings within the radius share all but 2 * radius of them, and one of the
    2 * radius + 1 rarest of either. Strings too short for that meet by length.
    """
    few, short = 2 * radius + 1, 2 * radius - 1
    a = left.where(F.col("place") <= few).select(F.col("u").alias("lu"), "g", "k", F.col("len").alias("ll"))
    b = right.where(F.col("place") <= few).select(F.col("u").alias("ru"), "g", "k", F.col("len").alias("rl"))
    met = a.join(b, ["g", "k"]).where(F.abs(F.col("ll") - F.col("rl")) <= radius).select("lu", "ru")
    one = F.col("place") == 1  # a row per string
    c = left.where(one & (F.col("len") <= short)).select(
        F.col("u").alias("lu"), F.explode(F.sequence(F.col("len") - radius, F.col("len") + radius))
        .alias("rl"))
    d = right.where(one & (F.col("len") <= short)).select(F.col("u").alias("ru"), F.col("len").alias("rl"))
    return met.unionByName(c.join(d, "rl").select("lu", "ru")).distinct()


def nearest_key(unmatched: DataFrame, key: str, registry: DataFrame,
                registry_key: str, radii: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Closest registry string by edit distance, case ignored.

    Strings look for registry strings within a widening radius through an index of their
    rarest pieces; what is found within a radius is surely the nearest. Only strings with
    nothing in the last radius, strings unlike any known one, meet every registry string.
    Ties go to the first key in order; an empty registry gives no rows.
    """
    rows = unmatched.where(F.col(key).isNotNull() & (F.col(key) != "")).select(
        F.col(key), F.upper(F.col(key)).alias("u")).distinct()
    known = cut_lineage(registry.where(F.col(registry_key).isNotNull()).groupBy(
        F.upper(F.col(registry_key)).alias("ru")).agg(F.min(registry_key).alias("nearest")))
    left = cut_lineage(_grams(rows.select("u").distinct()))
    right = cut_lineage(_grams(known.select(F.col("ru").alias("u"))))
    counts = left.unionByName(right).groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    left, right = cut_lineage(_rarest(left, counts)), cut_lineage(_rarest(right, counts))
    found, todo = None, left.where("place = 1").select(F.col("u").alias("lu"))

    def best(pairs: DataFrame, dist: Column) -> DataFrame:
        return pairs.join(known, "ru").select("lu", "nearest", dist.alias("distance")).where(
            "distance >= 0").groupBy("lu").agg(F.min(F.struct("distance", "nearest")).alias("b"))

    for radius in radii:
        pairs = within_distance(left, right, radius)
        got = cut_lineage(best(pairs.join(todo, "lu", "left_semi"),
                               F.levenshtein("lu", "ru", radius)))
        found = got if found is None else found.unionByName(got)
        todo = cut_lineage(todo.join(got, "lu", "left_anti"))
    rest = todo.crossJoin(small_side(known.select("ru")))  # strings near no key
    far = best(rest, F.levenshtein("lu", "ru"))
    found = far if found is None else found.unionByName(far)
    return rows.join(found, F.col("u") == F.col("lu")).select(key, "b.nearest", "b.distance")


def pair_attribute(df: DataFrame, pair: str, treat: str,
                   columns: Mapping[str, str]) -> DataFrame:
    """The treated member's attributes on both rows of its pair.

    ``columns`` maps source to output names. An aggregate over treated rows and
    a join: a pair of any size costs one row on the right side.
    """
    t = df.where(F.col(treat) == 1).groupBy(pair).agg(
        *[F.min(src).alias(out) for src, out in columns.items()])
    return df.join(t, pair, "left")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str],
              count_a: str = "n_a", count_b: str = "n_b") -> DataFrame:
    """Full outer merge of two counts per key, with their difference."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_a))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_b))
    out = x.join(y, list(keys), "full")
    na = F.coalesce(count_a, F.lit(0))
    nb = F.coalesce(count_b, F.lit(0))
    return out.select(*keys, na.alias(count_a), nb.alias(count_b),
                      (na - nb).alias("difference"))


def set_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both id sets, of their overlap and differences."""
    x = a.select(key).distinct().withColumn("__a", F.lit(1))
    y = b.select(key).distinct().withColumn("__b", F.lit(1))
    j = x.join(y, key, "full")
    has_a, has_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    return j.agg(n(has_a).alias("n_a"), n(has_b).alias("n_b"),
                 n(has_a & has_b).alias("n_both"),
                 n(has_a & ~has_b).alias("only_a"),
                 n(~has_a & has_b).alias("only_b")).withColumn(
        "equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def side_source(pairings: Mapping, treated: DataFrame, controls: DataFrame,
                group: str = "analysis_group") -> DataFrame:
    """Rows of every pairing: treated from the spaced sample, controls whole.

    A group can serve several pairings, so the membership table (a registry) is
    joined and rows fan out to the pairings they belong to.
    """
    from panelspark.operators.core import registry

    spark = treated.sparkSession
    t = registry(spark, ["pairing", group, "treat"], [
        (p, g, 1) for p, (tr, _c, _a) in pairings.items() for g in tr])
    c = registry(spark, ["pairing", group, "treat"], [
        (p, g, 0) for p, (_t, co, _a) in pairings.items() for g in co])
    return treated.join(t, group).unionByName(controls.join(c, group))
