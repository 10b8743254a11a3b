"""Near-duplicate documents by HyperMinHash.

A document's word shingles are hashed to 64 bits. The top bits choose one of ``REGISTERS`` buckets; of the least hash
in a bucket the register keeps the count of leading zeros and ten mantissa bits, 16 bits in all. Bands of four
registers propose candidates (a pair of similarity 0.8 is missed with a chance of about 2 in 10,000), the
collision-corrected estimate from ``FINE`` registers drops pairs that lie ``SPREAD`` standard deviations short of the
threshold (3 in a million of those at it), and the exact intersection of the full shingle sets decides. Components
follow from distributed union-find.

Equal sets are one class with its least doc_id before any pair is made, so copies cost one row each; members of a
large group of near copies are joined to one of them first, and what no link can reach is never paired (``links``). A set of fewer than four shingles can only
be linked with an equal one at 0.8, so it takes no part in banding.

Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer words than a shingle the whole sequence
is the only shingle; null and empty texts have an empty set and are linked with nothing. Rows with the same doc_id
are one node, each row keeps its own set size, and all that is linked with one of them is one component. A row
without doc_id has no component and is kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links, words
from .common import cut_lineage, narrow

REGISTERS = 64  # of which bands are made
FINE = 512  # of which similarity is estimated
BANDS = 16
MANTISSA = 10
SIMILAR = 80  # percent
LEAST_SET = 4
EMPTY = 0xFFFF
SPREAD = 4.5  # standard deviations short of the threshold at which an estimate drops a pair
FEW = 32  # an estimate that rests on fewer registers drops nothing


def shingles(w: words.Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of the slice."""
    g = words.grams(w.hashes, size)
    firsts = w.firsts
    for r in range(len(w.counts)):
        lo, hi = int(firsts[r]), int(firsts[r + 1])
        if hi - lo >= size:
            yield np.unique(g[lo : hi - size + 1])
        elif hi > lo:
            yield words.grams(w.hashes[lo:hi], hi - lo)
        else:
            yield np.zeros(0, dtype=np.uint64)


def registers(hashes: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """``count`` HyperMinHash registers of a sorted set of 64-bit hashes."""
    out = np.full(count, EMPTY, dtype=np.uint16)
    if not len(hashes):
        return out
    bits = count.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = hashes[first] << np.uint64(bits)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set and its registers, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, regs = [], [], [], []
            for w in words.word_slices(batch.column("text"), words.NOT_SPACE):
                for s in shingles(w, size):
                    n.append(len(s))
                    one.append(int(words.mix(s, 91).sum(dtype=np.uint64).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(words.mix(s, 92)).astype(np.int64)) if len(s) else 0)
                    regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n", "s1", "s2", "regs"])

    return narrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, the whole set of shingle hashes, and the registers to estimate by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for w in words.word_slices(batch.column("text"), words.NOT_SPACE):
                sets = list(shingles(w, size))
                offsets = pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32))
                flat = pa.array(words.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64))
                regs = pa.array([registers(s, FINE).view(np.int16) for s in sets], pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([ids.slice(w.lo, w.hi - w.lo), pa.ListArray.from_arrays(offsets, flat), regs], names=["id", "items", "fine"])

    return narrow(docs).mapInArrow(run, "id long, items array<long>, fine array<short>")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and how many registers each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & used
    width = np.maximum(used.sum(axis=1), 1)
    level, count = np.arange(54.0)[None, :], a.shape[1]

    def shares(n):  # chance that the least of n / count hashes has so many leading zeros
        m = np.maximum(n / count, 1)[:, None]
        return (1 - 0.5 ** (level + 1)) ** m - (1 - 0.5**level) ** m

    by_chance = (shares(na) * shares(nb)).sum(axis=1) / 2**MANTISSA
    return np.maximum(same.sum(axis=1) / width - by_chance, 0) / (1 - by_chance), width


def _hopeful(pairs: DataFrame, similar: int) -> DataFrame:
    """The pairs whose estimate is not far short of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, FINE) for c in ("fine_a", "fine_b")]
            got, width = estimate(*regs, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            t = similar / 100
            keep = (width < FEW) | (got >= t - SPREAD * np.sqrt(t * (1 - t) / width))
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long, n_a long, n_b long")


def near_components(docs: DataFrame, size: int, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, n, class id ``rep``; per class or doc_id that is not its component's least: id, component)."""
    rows = cut_lineage(sketches(docs, size))
    whole = rows.where("doc_id is not null and n > 0")
    classes = cut_lineage(whole.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("regs").alias("regs")))
    each = rows.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    each = cut_lineage(each)

    nodes = classes.where(F.col("n") >= LEAST_SET).select(F.col("rep").alias("id"), "n", "regs", "s1", "s2")
    width = 2 * REGISTERS // BANDS
    part = lambda i: F.substring("regs", i * width + 1, width)
    keyed = nodes.select("id", F.explode(F.array(*[F.when(part(i) != F.lit(b"\xff" * width), F.xxhash64(F.lit(i), part(i))) for i in range(BANDS)])).alias("key")).where("key is not null")
    members = links.groups(keyed)

    ids = members.select("id").distinct()
    texts = docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text").distinct()
    # A second text under the same doc_id is told from the class's own by its set size, else it is compared as well.
    sets = shingle_sets(texts, size).join(nodes.select("id", "n"), "id").where("size(items) = n")
    sets = cut_lineage(sets)

    def side(name: str, *cols: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])

    def verify(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(side("a", "n", "fine"), "a").join(side("b", "n", "fine"), "b").where(f"100 * least(n_a, n_b) >= {similar} * greatest(n_a, n_b)")
        full = _hopeful(narrow(sized), similar).join(side("a", "items"), "a").join(side("b", "items"), "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
        return full.where(f"100 * common >= {similar} * (n_a + n_b - common)").select("a", "b").distinct()

    def strength(some: DataFrame) -> DataFrame:
        own = links.lone_items(sets.join(some, "id"))
        return own.groupBy("id").agg(F.max("n").alias("n"), F.min("u").alias("u")).withColumn("own", F.col("u") / F.col("n")).join(sets.groupBy("id").agg(F.max("fine").alias("fine")), "id")

    def parities(some: DataFrame) -> DataFrame:
        dealt = sets.join(some, "id").select("id", "items").repartition("id")
        return links.parities(dealt.select("id", F.xxhash64("items").alias("part"), F.explode("items").alias("item"))).drop("n")

    # One pass over both register rows: 1000 for each that either set uses, 1 for each that is the same. Registers
    # sample the union without putting back, so the more of it they hold the less the estimate strays.
    t, none = similar / 100, EMPTY - 2**16
    seen = f"aggregate(zip_with(fine, pfine, (x, y) -> if(x <> {none} or y <> {none}, if(x = y, 1001, 1000), 0)), 0, (a, v) -> a + v)"
    stray = f"sqrt({t * (1 - t)} / (v div 1000) * greatest(0.02, 1 - (v div 1000) * {1 + t} / (n + pn)))"
    likely = f"exists(array({seen}), v -> if(v div 1000 < {FEW}, true, v % 1000 >= (v div 1000) * ({t} - {SPREAD} * {stray})))"
    found = links.linked(members, verify, strength, parities, similar, first=True, likely=likely)
    # Rows that share a doc_id but not a text tie their classes together.
    ties = whole.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc_id")
    ties = cut_lineage(each.join(ties, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    if not ties.isEmpty():
        old = ties if found is None else ties.union(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = links.components(old)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "id long, component long")
    return each, found


def report(docs: DataFrame, size: int, similar: int = SIMILAR) -> DataFrame:
    """One row per document: set size, component, and whether it is the one that stays."""
    each, found = near_components(docs, size, similar)
    named = each.join(found, each["rep"] == found["id"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def clean(docs: DataFrame, size: int, similar: int = SIMILAR) -> DataFrame:
    """One document of each component, with the columns it came with; of rows with its doc_id, all."""
    gone = report(docs, size, similar).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
