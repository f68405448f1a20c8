"""Joins with defaults, chains of fallbacks, hierarchies and intervals.

Lookups join by key and leave the strategy to the optimizer, which broadcasts only what its own size check allows.
Interval joins always have an equality on a contig or group and, for long inputs, on bins, so none is a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import rank_by_order


def unique_on(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the last in ``order``, or the greatest row where there is none; null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])) if order else F.max(F.struct(*rest))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__v")).select(key, "__v.*")


def lookup(df: DataFrame, column: str, words: DataFrame, word: str, value: str, name: str, default: str) -> DataFrame:
    """Adds ``name``: what ``words`` gives for the column in any case and without outer blanks, else ``default``.

    Words that are repeated count once, with the least value.
    """
    key = F.lower(F.trim(F.col(word)))
    once = words.select(key.alias("__k"), F.col(value).alias("__v")).where("__k is not null").groupBy("__k").agg(F.min("__v").alias("__v"))
    out = df.withColumn("__k", F.lower(F.trim(F.col(column)))).join(once, "__k", "left")
    return out.withColumn(name, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def class_of_products(df: DataFrame, row: str, products: str, words: DataFrame, word: str, value: str, default: str = "OTHER", pair: tuple[str, str] = ("PKS", "NRPS"), hybrid: str = "PKS_NRPS_HYBRID") -> DataFrame:
    """(row, class): the class of a list of products.

    Each entry may hold several products, cut at blanks and commas. Their classes in order, each once: both of ``pair``
    give ``hybrid``; else the first that is not ``default``; else ``default``. Rows with null or empty lists get it too.
    """
    text = F.concat_ws(",", F.col(products))
    parts = df.select(F.col(row).alias("__row"), F.posexplode_outer(F.split(F.lower(text), r"[\s,]+")).alias("__at", "__p"))
    key = F.lower(F.trim(F.col(word)))
    once = words.select(key.alias("__p"), F.col(value).alias("__v")).where("__p is not null").groupBy("__p").agg(F.min("__v").alias("__v"))
    found = parts.join(once, "__p", "left").where("__v is not null")
    first = found.groupBy("__row", "__v").agg(F.min("__at").alias("__at"))
    per = first.groupBy("__row").agg(
        F.count_if(F.col("__v").isin(*pair)).alias("__both"),
        F.min_by("__v", F.when(F.col("__v") != default, F.col("__at"))).alias("__first"),
    )
    out = df.select(F.col(row).alias("__row")).join(per, "__row", "left")
    return out.select(F.col("__row").alias(row), F.when(F.col("__both") == 2, hybrid).otherwise(F.coalesce("__first", F.lit(default))).alias("class"))


def redirected(df: DataFrame, key: str, redirects: DataFrame, old: str, new: str, values: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """Two left joins: outdated keys are replaced first, then the value is looked up; null if it is not there."""
    a = redirects.select(F.col(old).alias(key), F.col(new).alias("__new"))
    b = values.select(F.col(on).alias("__key"), F.col(value).alias(name))
    return df.join(a, key, "left").withColumn("__key", F.coalesce("__new", key)).join(b, "__key", "left").drop("__new", "__key")


def first_of(df: DataFrame, sources: list[tuple[DataFrame, str, str, Column]], name: str) -> DataFrame:
    """Adds ``name``: the first value that one of the sources (table, key, value, own key) has, in their order."""
    out, found = df, []
    for i, (table, key, value, own) in enumerate(sources):
        side = table.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__o{i}", own).join(side, F.col(f"__o{i}") == F.col(f"__k{i}"), "left").drop(f"__o{i}", f"__k{i}")
        found.append(f"__v{i}")
    return out.withColumn(name, F.coalesce(*found)).drop(*found)


def ancestors(nodes: DataFrame, node: str, parent: str, depth: int = 64) -> DataFrame:
    """(node, ancestor, distance) up to the root, itself included at 0.

    Cycles end where a node repeats; ``depth`` bounds the walk. Each round is one join of the frontier with the tree, which
    must be a table of distinct nodes (repeated rows count once).
    """
    tree = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("bigint").alias("n")).agg(F.min(F.col(parent).cast("bigint")).alias("p"))
    spark = nodes.sparkSession
    name = f"__tree_{id(tree)}"
    tree.createOrReplaceTempView(name)
    walk = spark.sql(
        f"""WITH RECURSIVE walk(node, ancestor, distance, path) MAX RECURSION LEVEL {depth + 2} AS (
            SELECT n, n, 0, array(n) FROM {name}
            UNION ALL
            SELECT w.node, t.p, w.distance + 1, array_append(w.path, t.p) FROM walk w JOIN {name} t ON w.ancestor = t.n
            WHERE t.p IS NOT NULL AND NOT array_contains(w.path, t.p) AND w.distance < {depth}
        ) SELECT node, ancestor, distance FROM walk"""
    )
    return walk


def lineage(nodes: DataFrame, node: str, parent: str, rank: str, name: str, ranks: dict[str, str], depth: int = 64) -> DataFrame:
    """One row a node with a column per wanted rank (values of ``ranks``; several rank names may share one): the nearest
    ancestor's name, trimmed; empty names and unknown ancestors give null."""
    walk = ancestors(nodes, node, parent, depth)
    told = nodes.groupBy(F.col(node).cast("bigint").alias("ancestor")).agg(F.min(F.trim(rank)).alias("rank"), F.min(F.trim(name)).alias("name"))
    mapped = F.lit(None).cast("string")
    for have, want in ranks.items():
        mapped = F.when(F.col("rank") == have, want).otherwise(mapped)
    both = walk.join(told, "ancestor").withColumn("want", mapped)
    picks = [F.min_by("name", F.when((F.col("want") == w) & (F.col("name") != ""), F.col("distance"))).alias(w) for w in dict.fromkeys(ranks.values())]
    return both.groupBy("node").agg(*picks)


def fuzzy_name(df: DataFrame, name: str, names: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the whole name, else of its first two words, else of the first; case ignored."""
    once = names.select(F.lower(F.trim(F.col(key))).alias("__k"), F.col(value).alias("__v")).where("__k is not null").groupBy("__k").agg(F.min("__v").alias("__v"))
    own = F.lower(F.trim(F.col(name)))
    words = F.split(own, r"\s+")
    tries = [own, F.when(F.size(words) > 2, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))), F.get(words, F.lit(0))]
    return first_of(df, [(once, "__k", "__v", t) for t in tries], out)


def enriched_with_flag(df: DataFrame, key: str, flags: DataFrame, flag_key: str, flag: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report): left join of a flag that is false where it is missing; the report counts matched and missing rows.

    A flag table with several rows a key counts with its last in ``order``.
    """
    side = unique_on(flags.select(F.col(flag_key).alias(key), F.col(flag).alias("__f"), *([F.col(order).alias("__o")] if order else [])), key, "__o" if order else None)
    both = df.join(side.select(key, F.struct("__f").alias("__m")), key, "left")
    report = both.agg(F.count("__m").alias("matched"), F.count_if(F.col("__m").isNull()).alias("missing"))
    return both.withColumn(flag, F.coalesce("__m.__f", F.lit(False))).drop("__m"), report


def cross_checked(df: DataFrame, side: DataFrame, row: str, check: str) -> DataFrame:
    """Inner join by row number in which both sides must agree on ``check``; the query fails where they differ."""
    other = side.withColumnRenamed(check, "__check")
    both = df.join(other, row)
    same = F.col(check).eqNullSafe(F.col("__check"))
    return both.withColumn("__ok", F.when(same, True).otherwise(F.raise_error(F.concat(F.lit(f"{check} differs in row "), F.col(row).cast("string"))).cast("boolean"))).where("__ok").drop("__ok", "__check")


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str, check: str) -> DataFrame:
    """Joins two tables by rank within ``check`` groups of equal order; fails if a row has no partner or ``check`` differs.

    ``check`` is a column of both (such as a length). Orders are unique numbers, ranked by ranges in many tasks.
    """
    x = rank_by_order(a, order_a, "__n")
    y = rank_by_order(b, order_b, "__n").select(*[F.col(c).alias(f"b_{c}") for c in b.columns], "__n")
    both = x.join(y, "__n", "full")
    fine = F.col(check).eqNullSafe(F.col(f"b_{check}"))
    return both.withColumn("__ok", F.when(fine, True).otherwise(F.raise_error(F.lit("the tables do not line up")).cast("boolean"))).where("__ok").drop("__ok", "__n")


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right, difference) for keys of both arms; a key repeated in an arm counts with its mean."""
    x = a.groupBy(key).agg(F.avg(value).alias("left"))
    y = b.groupBy(key).agg(F.avg(value).alias("right"))
    return x.join(y, key).withColumn("difference", F.col("right") - F.col("left"))


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def _bins(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(start, end - 1)
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor(last / width).cast("bigint"))


def contained(inner: DataFrame, outer: DataFrame, on: list[str], width: int = 10_000) -> DataFrame:
    """Pairs of an inner and an outer interval (columns s, e and o_s, o_e) of equal ``on`` with o_s <= s and e <= o_e.

    Joined on (on, bin): an inner interval is in the bin of its start, an outer one in every bin it touches.
    """
    a = inner.withColumn("__bin", F.floor(F.col("s") / width).cast("bigint"))
    b = outer.withColumn("__bin", F.explode(_bins(F.col("o_s"), F.col("o_e") + 1, width)))
    return a.join(b, [*on, "__bin"]).where("s >= o_s and e <= o_e").drop("__bin")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width: int = 10_000) -> DataFrame:
    """Pairs of intervals [s, e) and [o_s, o_e) of equal ``on`` that share a position, with the shared part [c_s, c_e).

    Both are in every bin they touch; a pair is kept in the bin where its shared part starts, so it comes once.
    """
    x = a.withColumn("__bin", F.explode(_bins(F.col("s"), F.col("e"), width)))
    y = b.withColumn("__bin", F.explode(_bins(F.col("o_s"), F.col("o_e"), width)))
    both = x.join(y, [*on, "__bin"]).where("e > o_s and s < o_e")
    both = both.withColumn("c_s", F.greatest("s", "o_s")).withColumn("c_e", F.least("e", "o_e"))
    return both.where(F.floor(F.col("c_s") / width) == F.col("__bin")).drop("__bin")


def touching_none(a: DataFrame, b: DataFrame, on: list[str], row: str, width: int = 10_000) -> DataFrame:
    """Rows of ``a`` whose interval shares no position with any of ``b``; ``row`` is unique in ``a``."""
    hit = overlapping(a.select(row, *on, "s", "e"), b, on, width).select(row).distinct()
    return a.join(hit, row, "left_anti")


def nearest_size(wanted: DataFrame, pool: DataFrame, key: str, wanted_size: str, pool_size: str) -> DataFrame:
    """Control matching without replacement: within ``key`` the n-th longest wanted row gets the n-th longest of the pool.

    Both sides are ranked by size (ties by id column ``id``), so the pairing is one join and does not depend on order.
    """
    a = wanted.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(wanted_size), "id")))
    b = pool.select(F.col("id").alias("control_id"), key, F.col(pool_size).alias("control_size"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pool_size), "id")).alias("__r"))
    return a.join(b, [key, "__r"], "left").drop("__r")


def islands(df: DataFrame, key: str) -> DataFrame:
    """(key, covered, pieces): how many positions the union of a key's intervals [s, e) covers, in how many pieces."""
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where("e > s").withColumn("__to", F.max("e").over(before))
    new = F.coalesce((F.col("s") > F.col("__to")).cast("int"), F.lit(1))
    gain = F.greatest(F.col("e") - F.greatest("s", F.coalesce("__to", "s")), F.lit(0))
    return rows.groupBy(key).agg(F.sum(gain).alias("covered"), F.sum(new).alias("pieces"))


def cross_class_pairs(df: DataFrame, taxon: str, label: str, row: str) -> DataFrame:
    """(taxon, label_a, label_b, pairs): how many pairs of rows of one taxon have two labels, or the same one.

    Counted from the rows per (taxon, label), so no pair is ever written out.
    """
    n = df.groupBy(taxon, label).agg(F.countDistinct(row).alias("n"))
    a, b = n.select(taxon, F.col(label).alias("label_a"), F.col("n").alias("na")), n.select(taxon, F.col(label).alias("label_b"), F.col("n").alias("nb"))
    both = a.join(b, taxon).where("label_a <= label_b")
    pairs = F.when(F.col("label_a") == F.col("label_b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    return both.select(taxon, "label_a", "label_b", pairs.alias("pairs")).where("pairs > 0")


def with_fallback_key(df: DataFrame, side: DataFrame, keys: list[Column], side_key: str, value: str) -> DataFrame:
    """Adds the side's value for the first of several keys that is not null (accession, else id, else row number)."""
    b = side.select(F.col(side_key).cast("string").alias("__k"), F.col(value))
    return df.withColumn("__k", F.coalesce(*[k.cast("string") for k in keys])).join(b, "__k", "left").drop("__k")


def resolved_profile(df: DataFrame, key: str, group: str, profiles: DataFrame, profile_key: str, value: str) -> DataFrame:
    """Adds the profile of the key, else of the key in upper case, else of the group, else of that in upper case."""
    side = profiles.groupBy(F.col(profile_key).alias("__p")).agg(F.min(value).alias("__pv"))
    tries = [F.col(key), F.upper(F.col(key)), F.col(group), F.upper(F.col(group))]
    return first_of(df, [(side, "__p", "__pv", t) for t in tries], value)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
