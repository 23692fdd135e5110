"""Merkle manifest of a table: roots, and for each row the proof of its leaf.

Leaves stand in order in blocks of `BLOCK` places. A block keeps each of its
levels as one string of hex digests: eight digests, a substring of fixed width,
hash to a parent, so a level is made from the one below by substrings alone. The
digests that are left of all blocks are the leaves of the next round, until a
tree has one block. On the way down a row's siblings are the substrings left
and right of it in its run, level by level, followed by those of its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.ranks import nulls_first, ranked
from brightledger.llm.tables import settled

FAN, WIDTH = 8, 64
#: Levels of a block, and its places.
LEVELS = 3
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def row_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the values one after another: `-` for null,
    else the count of UTF-8 bytes, `:` and the value as text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def _runs(level: Column) -> Column:
    """The runs of a level: its substrings of eight digests, the last as long as it is."""
    last = F.ceil(F.length(level) / (FAN * WIDTH)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(level, i * (FAN * WIDTH) + 1, FAN * WIDTH))


def _blocks(nodes: DataFrame) -> DataFrame:
    """The blocks of trees given as rows (tree, n, place, digest, item): their
    members in order, their levels, and `digest`, what is left of them. A tree
    of one block ends with one digest; the blocks of others are alike in height."""
    member = F.struct("place", "digest", "item")
    held = nodes.groupBy("tree", "n", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(F.sort_array(F.collect_list(member), asc=True).alias("members"))
    held = held.withColumn("level0", F.array_join("members.digest", ""))
    digest = F.col("level0")
    for k in range(1, LEVELS + 1):
        below = F.col(f"level{k - 1}")
        held = held.withColumn(f"level{k}", F.when(F.col("n") > FAN ** (k - 1), F.array_join(F.transform(_runs(below), lambda run: F.sha2(run, 256)), "")))
        digest = F.coalesce(F.col(f"level{k}"), digest)
    return held.withColumn("digest", digest)


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, one for each round, and the root of each tree."""
    tables = []
    while True:
        blocks = settled(_blocks(nodes), "blocks")
        tables.append(blocks)
        more = blocks.where(F.col("n") > BLOCK)
        if not more.limit(1).count():
            break
        blocks_of_tree = F.ceil(F.col("n") / BLOCK).cast("long")
        nodes = more.select("tree", blocks_of_tree.alias("n"), F.col("block").alias("place"), "digest", F.struct(F.lit(None).cast("long").alias("none")).alias("item"))
    roots = [t.where(F.col("n") <= BLOCK).select("tree", "digest", "n") for t in tables]
    whole = roots[0]
    for other in roots[1:]:
        whole = whole.unionByName(other)
    return tables, whole


def _paths(blocks: DataFrame) -> DataFrame:
    """(tree, place, digest, item, path) of the members of blocks with a path:
    a member's siblings in its runs, then those of the block."""

    def siblings(runs: Column, place: Column, k: int) -> Column:
        at = F.floor(place / FAN**k)
        run, own = F.get(runs, F.floor(at / FAN).cast("int")), (at % FAN * WIDTH).cast("int")
        return F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + WIDTH + 1, F.lit(FAN * WIDTH)).alias("right"))

    def member(m: Column, levels: Column) -> Column:
        place, none = m["place"] % BLOCK, F.array().cast(_PATH)
        inner = [F.when(levels[f"runs{k}"].isNotNull(), F.array(siblings(levels[f"runs{k}"], place, k))).otherwise(none) for k in range(LEVELS)]
        return F.struct(m["place"].alias("place"), m["digest"].alias("digest"), m["item"].alias("item"), F.concat(*inner, levels["path"]).alias("path"))

    # The runs are cut once for a block: a level with a parent has runs.
    runs = [F.when(F.col(f"level{k + 1}").isNotNull(), _runs(F.col(f"level{k}"))).alias(f"runs{k}") for k in range(LEVELS)]
    once = F.transform(F.array(F.struct(*runs, "path")), lambda levels: F.transform(F.col("members"), lambda m: member(m, levels)))
    return blocks.select("tree", F.explode(F.get(once, 0)).alias("m")).select("tree", "m.*")


def _descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, place, digest, item, path) of the leaves; `tops` has the path of each tree's root."""
    above = None
    for blocks in reversed(tables):
        rows = blocks.where(F.col("n") <= BLOCK).join(tops, "tree")
        if above is not None:
            inner = above.select("tree", F.col("place").alias("block"), "path")
            rows = rows.unionByName(blocks.where(F.col("n") > BLOCK).join(inner, ["tree", "block"]))
        above = _paths(rows)
    return above


def _tree(leaves: DataFrame) -> DataFrame:
    """Rows (tree, item, digest, place) with n, the size of their tree."""
    return leaves.join(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_column: str = "lang", id_column: str = "doc_id", shown: Column | None = None) -> DataFrame:
    """doc_id, leaf, shown, subroot, root and path of every row: `path` has the
    siblings of the row's leaf from its own run up to the root, as digests left
    and right of it; `shown` is the leaf to be proved, the row's own by default.

    A leaf is `row_digest` of the columns. The leaves of a group ascend by id
    (null first), equal ids by digest; while more than one node is left, eight
    consecutive ones become a parent, fewer at the end (even one). The groups'
    roots, by group (null first, then by bytes), make the root in the same way.
    Rows may repeat and then are leaves of their own. An empty table gives no
    rows. `root` passes through the driver, nothing else does.
    """
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    leaf = row_digest([col(c) for c in columns])
    hashed = docs.select(nulls_first(col(group_column)).alias("tree"), col(id_column).alias("doc_id"), leaf.alias("digest"), (leaf if shown is None else shown).alias("shown"))
    hashed = settled(hashed, "leaves")
    placed = ranked(hashed, "tree", ["doc_id", "digest"], "leaf-order")
    tables, subroots = _climb(_tree(placed.select("tree", "place", "digest", F.struct("doc_id", "shown").alias("item"))))
    subroots = settled(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "subroots")
    root_nodes = ranked(subroots, "tree", ["key"], "subroot-order").select("tree", "place", "digest", F.struct("key").alias("item"))
    root_tables, roots = _climb(_tree(root_nodes))
    root = roots.first()
    nothing = F.array().cast(_PATH)
    tops = _descend(root_tables, docs.sparkSession.range(1).select(F.lit("").alias("tree"), nothing.alias("path")))
    tops = settled(tops.select(F.col("item.key").alias("tree"), F.col("digest").alias("subroot"), "path"), "tops")
    proved = _descend(tables, tops.select("tree", "path")).join(tops.select("tree", "subroot"), "tree")
    return proved.select("item.doc_id", F.col("digest").alias("leaf"), "item.shown", "subroot", F.lit(root["digest"] if root else None).alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of this path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def tampered_rows(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_column: str = "doc_id", text_column: str = "text") -> Column:
    """The leaf of a row after tampering: where 3 divides the crc32 of the id as
    text (null never), the text's A-Z are lower-cased."""
    low = F.translate(text_column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = row_digest([low if c == text_column else F.col(c) for c in columns])
    return F.when(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 0, changed).otherwise(row_digest([F.col(c) for c in columns]))
