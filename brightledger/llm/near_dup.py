"""Near-duplicate documents by an inverted join of MinHash signatures.

A document's set of word shingles has a signature of least hashes. Each
coordinate and its value is a posting list of documents; two documents with
enough equal coordinates are compared by their full sets.

1. Equal sets are one class. Values of one class only can't collide and are
   dropped; a class with fewer shared values than the match threshold has no
   partner.
2. Prefix: of its s shared values, ordered by rarity, a class posts the rarest
   s - t + 1; two classes with t equal values meet under one of them at least.
   Classes that meet are one cluster; clusters are made by label propagation
   and no pair is written.
3. Inside a cluster a class merges its shortest posting lists only, those that
   a partner with t equal values can't all miss; whoever is in one is looked up
   in the longer lists to count collisions. Pairs of one component are skipped,
   pairs with t or more equal values are confirmed on full sets. Clusters too large for one task are compared with their most
   common text first; whatever is not linked to it is dealt in blocks, and every
   pair of blocks meets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import LOWER, SPACED, mix, shingle_hashes, slices, text_bytes, word_bounds, word_hashes
from brightledger.llm.graph import components, spanning
from brightledger.llm.tables import settled
from brightledger.llm.url_filter import bloom_blocks, possible

SHINGLE, PERCENT = 5, 80
COORDINATES = 64
#: Two sets with similarity 0.8 share 51 of 64 coordinates on average; fewer
#: than 36 have a probability below 1 in 100,000.
MATCHES = 36
#: Classes that are compared in one task.
BLOCK_CLASSES = 2000

_MULTIPLIERS = np.random.default_rng(8191).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = np.random.default_rng(131071).integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: lower-cased A-Z, words
    `[^\\x20\\x09-\\x0D]+`, `size` consecutive words; all words as one shingle
    if there are fewer; empty without words or text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets, SPACED)
    words = word_hashes(data, starts, ends)
    hashes = shingle_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(hashes[at : at + n - size + 1]))
        else:
            out.append(shingle_hashes(words[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def _signatures(sets: list[np.ndarray], coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys and signatures (uint32) of non-empty sets."""
    whole = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    sums = np.stack([np.add.reduceat(mix(whole), starts), np.add.reduceat(mix(whole ^ np.uint64(0x5851F42D4C957F2D)), starts)], axis=1)
    signature = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        signature[:, k] = np.minimum.reduceat(((whole * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return sums, signature


def signatures(docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (hash of the set, null if it is empty),
    signature of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("signature", pa.list_(pa.int32()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            classes, rows = [None] * len(sets), [None] * len(sets)
            if full:
                keys, values = _signatures([sets[i] for i in full], coordinates)
                keys = mix(keys[:, 0] + mix(keys[:, 1])).view(np.int64).tolist()
                values = list(values.view(np.int32))
                for k, i in enumerate(full):
                    classes[i], rows[i] = keys[k], values[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], schema=schema)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(sign, "doc_id long, n_shingles long, class long, signature array<int>")


def _clusters(classes: DataFrame, matches: int) -> DataFrame:
    """(class, cluster) of classes that may have a partner."""
    postings = classes.select("class", F.posexplode("signature").alias("place", "value"))
    postings = postings.select("class", (F.col("place").cast("long") * (1 << 32) + F.col("value").cast("long") + (1 << 31)).alias("key"))
    shared = settled(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = postings.join(shared, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= matches)
    prefix = settled(met.select("class", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (matches - 1))).alias("k")).select("class", "k.key"), "prefixes")
    first = settled(prefix.groupBy("key").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    edges = prefix.join(first, "key").where("class <> a").select("a", F.col("class").alias("b"))
    # A class has an edge under each of its prefix keys; one is enough.
    return components(spanning(edges)).select(F.col("node").alias("class"), F.col("label").alias("cluster"))


class _Links:
    """Union-find over the classes of one task; keeps the edges that join."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up.copy()
        return up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Postings:
    """The posting lists of one task's classes, by coordinate and value."""

    def __init__(self, values: np.ndarray, matches: int):
        coordinates = values.shape[1]
        keys = values.astype(np.int64) + (np.arange(coordinates, dtype=np.int64) << 33)
        _, of, lengths = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        self.of = of.reshape(values.shape)
        self.classes = np.argsort(of.ravel(), kind="stable") // coordinates  # list after list
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        # Whoever has `matches` equal values is in one of the shortest lists.
        self.merged = np.argsort(lengths[self.of], axis=1, kind="stable")[:, : coordinates - matches + 1]

    def later(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The classes after i in one of its shortest lists, and their numbers
        of equal values; the long lists are not merged but looked up."""
        there = np.zeros(len(self.of), bool)
        short = self.of[i, self.merged[i]]
        for start, end in zip(self.starts[short].tolist(), self.ends[short].tolist()):
            there[self.classes[start:end]] = True
        there[: i + 1] = False
        js = np.flatnonzero(there)
        return js, np.count_nonzero(self.of[js] == self.of[i], axis=1)


def link(classes: list[int], values: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, matches: int, percent: int) -> list[tuple[int, int]]:
    """Edges that join the similar classes of one task. With two groups given,
    pairs within one group are left to other tasks (0 alone: all pairs)."""
    links, sizes = _Links(len(classes)), np.array([len(s) for s in sets])
    apart, postings = bool(groups.any()), _Postings(values, matches)
    for i in range(len(classes) - 1):
        js, equal = postings.later(i)
        roots = links.roots()
        near = (equal >= matches) & (roots[js] != roots[i])
        near &= (percent * sizes[js] <= 100 * sizes[i]) & (percent * sizes[i] <= 100 * sizes[js])
        if apart:
            near &= groups[js] != groups[i]
        js, equal = js[near], equal[near]
        for j in js[np.argsort(-equal, kind="stable")].tolist():
            if links.root(i) != links.root(j) and similar(sets[i], sets[j], percent):
                links.join(i, j)
    return [(classes[i], classes[j]) for i, j in links.edges]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, block_classes: int = BLOCK_CLASSES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked with the document
    directly or through others, itself included) and kept (doc_id is
    component_id) of each row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their
    shingle sets (64-bit hashes stand for shingles). Empty sets are linked with
    nothing. Rows without an id join no class and have a null component and are
    kept; rows that share an id and a text are alike. `matches` of `coordinates`
    equal values make a candidate. Empty tables give empty results.
    """
    signed = settled(signatures(docs, size, coordinates, id_column, text_column), "signatures")
    named = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = settled(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")), "classes")
    clusters = settled(_clusters(classes, matches), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = settled(sizes, "sizes")
    members = settled(clusters.join(sizes, "cluster").join(classes.drop("copies"), "class"), "members")
    # One text for each class; the filter keeps other documents out of the shuffle.
    wanted = members.select("doc_id")
    texts = possible(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where(F.col("doc_id").isNotNull()), "doc_id", bloom_blocks(wanted, "doc_id"))
    held = settled(texts.join(members, "doc_id").select("class", "cluster", "n", "signature", "text"), "texts")
    small = held.where(F.col("n") <= block_classes).select("cluster", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "class", "signature", "text")
    edges = _compared(small, size, percent, matches)
    if sizes.where(F.col("n") > block_classes).limit(1).count():
        large = held.where(F.col("n") > block_classes)
        edges = edges.unionByName(_large(large, classes, size, percent, matches, block_classes))
    edges = settled(edges, "links")
    labels = components(edges)
    least = labels.withColumnRenamed("node", "class").join(classes.select("class", "doc_id"), "class")
    least = least.select("label", "class", "doc_id")
    roots = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = labels.withColumnRenamed("node", "class").join(roots, "label").select("class", "component_id")
    copied = classes.where("copies > 1").select("class", "doc_id")
    of_class = copied.join(found, "class", "full").select("class", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = settled(of_class, "components")
    result = signed.drop("signature").join(of_class, "class", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _compared(rows: DataFrame, size: int, percent: int, matches: int) -> DataFrame:
    """Edges (a, b) found in each group (cluster, left, right) of rows, which
    come one after another in a partition."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, classes, values, sets, sides, out = None, [], [], [], [], []

        def close() -> None:
            if len(set(classes)) > 1:
                first = np.unique(classes, return_index=True)[1]  # a class once, should rows repeat
                out.extend(link([classes[i] for i in first], np.stack([values[i] for i in first]), [sets[i] for i in first], np.array([sides[i] for i in first]), matches, percent))

        for batch in slices(batches):
            cut = shingle_sets(batch.column(6), size)
            # An id may have several texts: the class tells which one is meant.
            keys = [None if not len(s) else k for s, k in zip(cut, _classes(cut))]
            for k, (c, left, right, side, cls, value) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)))):
                if (c, left, right) != key:
                    close()
                    key, classes, values, sets, sides = (c, left, right), [], [], [], []
                if keys[k] == cls:
                    classes.append(cls)
                    values.append(np.array(value, np.int32))
                    sets.append(cut[k])
                    sides.append(side)
            if out:
                yield _edges(out)
                out = []
        close()
        if out:
            yield _edges(out)

    dealt = rows.select("cluster", "left", "right", "side", "class", "signature", "text").repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "class")
    return dealt.mapInArrow(compare, "a long, b long")


def _classes(sets: list[np.ndarray]) -> list[int]:
    out = []
    for s in sets:
        sums = [np.add.reduce(mix(x)) for x in (s, s ^ np.uint64(0x5851F42D4C957F2D))] if len(s) else [np.uint64(0)] * 2
        out.append(int(mix(np.array([sums[0]]) + mix(np.array([sums[1]]))).view(np.int64)[0]))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _large(held: DataFrame, classes: DataFrame, size: int, percent: int, matches: int, block_classes: int) -> DataFrame:
    """Edges of clusters of more than `block_classes` classes.

    All are compared with the class that has the most copies. Those linked with
    it are one component and needn't meet again; every other class meets all
    classes of the cluster, block by block.
    """
    pivots = held.join(classes.select("class", "copies"), "class").groupBy("cluster").agg(F.max_by("text", F.struct("copies", "class")).alias("pivot"), F.max_by("class", F.struct("copies", "class")).alias("a"))
    pivots = settled(pivots, "pivots")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mine, pivot = shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size)
            near = [similar(x, y, percent) for x, y in zip(mine, pivot)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["class", "a", "near"])

    tested = held.join(pivots, "cluster").select("class", "a", "text", "pivot").mapInArrow(confirm, "class long, a long, near boolean")
    tested = settled(tested, "tested")
    star = tested.where("near and class <> a").select("a", F.col("class").alias("b"))
    # The pivot stands for itself among the linked ones.
    sides = held.join(tested.select("class", "near"), "class")
    count = settled(sides.groupBy("cluster").agg(F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("alone"), F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("linked")), "sides")
    half = max(1, block_classes // 2)
    blocks = lambda c: F.ceil(F.col(c) / half).cast("int")
    dealt = sides.join(count, "cluster").withColumns({"n_alone": blocks("alone"), "n_linked": blocks("linked")})
    place = F.pmod(F.xxhash64("class"), F.greatest(F.when(F.col("near"), F.col("n_linked")).otherwise(F.col("n_alone")), F.lit(1))).cast("int")
    dealt = dealt.withColumn("mine", F.when(F.col("near"), -1 - place).otherwise(place))
    # Blocks of classes not linked are numbered from 0, linked ones from -1 down.
    up = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    down = F.transform(up(F.col("n_linked")), lambda i: -1 - i)
    others = F.when(F.col("near"), up(F.col("n_alone"))).otherwise(F.concat(up(F.col("n_alone")), down))
    pairs = dealt.withColumn("other", F.explode(others))
    side = F.when(F.col("mine") == F.col("other"), 0).otherwise(F.when(F.col("mine") < F.col("other"), 1).otherwise(2))
    blocked = pairs.select("cluster", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), side.alias("side"), "class", "signature", "text")
    return _compared(blocked, size, percent, matches).unionByName(star)
