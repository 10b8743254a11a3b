"""Components over candidate groups: distributed union-find, and links found without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

PARITY = 16  # words of 64 bits that a set's items are folded into


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the undirected edges (a, b) but the least of its component.

    Alternates large-star and small-star steps until every node hangs from a node that hangs from none: its
    component's least id. Each step folds per node before it joins, and no row ever holds a neighbour list.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut_lineage(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        hangs = e.select(F.col("hi").alias("lo")).distinct()
        moving = e.join(hangs, "lo", "left_semi").select("hi").union(e.groupBy("hi").count().where("count > 1").select("hi"))
        if moving.isEmpty():
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def groups(rows: DataFrame) -> DataFrame:
    """The rows (key, id) of keys that more than one id has, written once. They are worked out and dealt out once."""
    # A window, not a join of the rows with their own keys: that worked the rows out for each side.
    own = Window.partitionBy("key")
    shared = rows.repartition("key").select("key", "id", F.min("id").over(own).alias("lo"), F.max("id").over(own).alias("hi")).where("lo < hi")
    return cut_lineage(shared.select("key", "id").distinct())


def lone_items(sets: DataFrame) -> DataFrame:
    """(id, n, u) of the sets (id, items): their size, and how many of their items no other of these sets has."""
    owned = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    return sets.select("id", F.size("items").alias("n")).join(owned.groupBy("id").agg(F.count("*").alias("u")), "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))


def parities(rows: DataFrame) -> DataFrame:
    """(id, n, w0, w1, ...) of every set of items (id, part, item): its size, and words of which each item turns one bit.

    Two sets differ in at least as many items as their words do in bits. ``part`` tells sets of one id apart.
    """
    bit = F.expr("shiftleft(1L, cast(shiftright(item, 40) & 63 as int))")
    word = F.shiftright("item", 50).bitwiseAND(F.lit(PARITY - 1))
    words = rows.groupBy("id", "part").agg(F.count("*").alias("n"), *[F.bit_xor(F.when(word == i, bit)).alias(f"w{i}") for i in range(PARITY)])
    return words.select("id", "n", *[F.coalesce(f"w{i}", F.lit(0).cast("long")).alias(f"w{i}") for i in range(PARITY)])


def may_link(a: str, b: str, similar: int, p: str = "") -> str:
    """Whether the ``parities`` of two sets, columns that end in ``a`` and ``b`` (and begin with ``p``), allow a link."""
    apart = " + ".join(f"bit_count(w{i}{a} ^ {p}w{i}{b})" for i in range(PARITY))
    return f"{100 + similar} * ({apart}) <= {100 - similar} * (n{a} + {p}n{b})"


def renamed(rows: DataFrame, side: str) -> DataFrame:
    """The rows of ids as those of one side of a pair: ``side`` is the id, and ends the names of the other columns."""
    return rows.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in rows.columns])


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], strength: Callable[[DataFrame], DataFrame], words: Callable[[DataFrame], DataFrame], similar: int, first: bool, likely: str = "true", few: int = 1) -> DataFrame | None:
    """Components over every verified pair of ids that share a key; None if no pair verifies.

    ``members`` has (key, id); ``verify`` keeps the pairs (a, b) of at least ``similar`` per cent Jaccard similarity;
    ``strength`` gives (id, n, u, own) for ids: set size, items that no other of these ids has (0 where not counted), and
    about how large a part of the set those are, by which members are chosen to compare with; and further columns that
    the condition ``likely`` may read (of the other member with ``p`` before their names); ``words`` gives the
    ``parities`` of ids. All members of a group are compared with one that has few items of its own and components joined; only groups that still hold several go on.
    Unless strengths come ``first``, which costs more, one round with any member thins out the groups before.
    Groups of at most ``few`` members do not take part in that: all their pairs are compared at once, before.

    What no link can reach drops out exactly, before it is paired: a and b have at most min(n_a - u_a, n_b - u_b) items
    in common and at least n_a + u_b in their union. So a member goes when even the least u of the group's other
    components is too large for it, as most of those do that share a group by one common passage. What is left is
    compared in full, but only across components, only where the bound, the words of both (``parities``) and ``likely``
    allow a link, and a pair only under the least key it shares. So no link is lost, and neither a large group of near
    copies nor one with a long common passage becomes all its pairs.
    """
    live, tested, good, labels = members.withColumn("comp", F.col("id")), None, None, None

    def compare(pairs: DataFrame) -> None:
        nonlocal live, tested, good, labels
        pairs = _pairs(pairs) if tested is None else _pairs(pairs).join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        found = cut_lineage(verify(pairs).select("a", "b"))
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            good = found if good is None else good.union(found)
            labels = components(good)
            live = live.drop("comp").join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def with_one(rank: list) -> DataFrame:
        one = live.groupBy("key").agg(F.min(F.struct(*rank, F.xxhash64("id").alias("h"), "id", "comp")).alias("p"))
        return live.join(one, "key").where(F.col("comp") != F.col("p.comp")).select(F.col("id").alias("a"), F.col("p.id").alias("b"))

    if few > 1:
        sized = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
        own = sized.where(f"size <= {few}").select("key", F.col("id").alias("a"))
        compare(own.join(own.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b"))
        large = sized.where(f"size > {few}").select("key", "id")
        live = large.withColumn("comp", F.col("id")) if labels is None else large.join(labels, "id", "left").select("id", "key", F.coalesce("component", "id").alias("comp"))
        live = cut_lineage(_mixed(live))
        if live.isEmpty():
            return labels
    if not first:
        compare(with_one([]))
    live = _open(live, similar, strength)
    compare(with_one([F.floor(20 * F.col("own")).alias("g")]))
    live = _open(live, similar, None)
    if live.isEmpty():
        return labels
    live = live.join(live.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
    live = cut_lineage(live.join(words(live.select("id").distinct()), "id"))
    other = live.select(*[F.col(c).alias(f"p{c}") for c in live.columns])
    bound = f"100 * least(n - u, pn - pu) >= {similar} * (n + pn - least(n - u, pn - pu))"
    apart = may_link("", "", similar, "p")
    left = live.join(other, F.expr(f"key = pkey and comp < pcomp and {bound} and {apart} and array_min(array_intersect(keys, pkeys)) = pkey and {likely}"))
    compare(left.select(F.col("id").alias("a"), F.col("pid").alias("b")))
    return labels


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open(live: DataFrame, similar: int, strength: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The members (with n and u) that may still have a link to another component of their group."""
    if strength is not None:
        live = cut_lineage(_mixed(live))
        own = strength(live.select("id").distinct()).where(f"100 * (n - u) >= {similar} * n")
        live = live.join(own, "id")
    live = cut_lineage(_mixed(live))
    best = live.groupBy("key").agg(F.min(F.struct("u", "comp")).alias("f")).select("key", F.col("f.u").alias("u1"), F.col("f.comp").alias("c1"))
    second = live.join(best, "key").where("comp <> c1").groupBy("key").agg(F.min("u").alias("u2"))
    bounds = best.join(second, "key")
    return cut_lineage(live.join(bounds, "key").where(f"100 * (n - u) >= {similar} * (n + if(comp = c1, u2, u1))").drop("u1", "c1", "u2"))


def _mixed(live: DataFrame) -> DataFrame:
    """The rows of keys that hold several components."""
    return live.join(live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "key")
