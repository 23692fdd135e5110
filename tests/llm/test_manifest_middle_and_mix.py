"""Merkle manifest, fill-in-middle texts, mixing of sources."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from brightledger.llm import manifest as tree
from brightledger.llm.fill_middle import Lanes, draws, fill_in_middle, restored
from brightledger.llm.manifest import fold, manifest, proof_digest, tampered_rows
from brightledger.llm.mixing import mix_copies, mixed, source_targets
from tests.llm.helpers import LOW, SPACED, documents, texts

FULL = "doc_id long, source string, lang string, n_chars long, text string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    cells = [None if v is None else str(v) for v in row]
    return _h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in cells))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _siblings(levels, place):
    out = []
    for level in levels[:-1]:
        run = place // 8 * 8
        out.append((level[run:place], level[place + 1 : run + 8]))
        place //= 8
    return out


def _plain(rows):
    """The contract, row by row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((members, _levels([_leaf(r) for r in members])))
    top = _levels([levels[-1][0] for _, levels in trees])
    out = []
    for k, (members, levels) in enumerate(trees):
        for i, row in enumerate(members):
            path = _siblings(levels, i) + _siblings(top, k)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            node = _leaf((*row[:4], row[4].translate(LOW))) if tampered else _leaf(row)
            for left, right in path:
                node = _h(*left, node, *right)
            proof = _h(*(d for left, right in path for d in (*left, *right)))
            out.append((row[0], _leaf(row), levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def _proved(df):
    rows = manifest(df, shown=tampered_rows(df)).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold(F.col("shown"), F.col("path")).alias("node"))
    return sorted((tuple(r) for r in rows.withColumn("ok", F.col("node") == F.col("root")).collect()), key=repr)


def _rows(n, seed=3):
    rng = random.Random(seed)
    words = texts(n, seed)
    return [(i, rng.choice(["web", "é:1", None]), rng.choices(["en", "de", None, "", "x1"], [8, 3, 1, 1, 1])[0], rng.choice([None, 5, -3]), words[i]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 70])
def test_manifest_of_small_tables(spark, n):
    rows = _rows(n)
    assert _proved(spark.createDataFrame(rows, FULL).repartition(4)) == _plain(rows)


def test_manifest_of_several_rounds(spark, monkeypatch):
    # Blocks of eight places: trees of up to four rounds, and 70 groups that need two.
    monkeypatch.setattr(tree, "LEVELS", 1)
    monkeypatch.setattr(tree, "BLOCK", 8)
    rows = [(i, "s", f"l{i % 70 if i % 2 else 0:02d}", i, f"Text {i}") for i in range(1200)]
    assert _proved(spark.createDataFrame(rows, FULL).repartition(5)) == _plain(rows)


def test_manifest_of_blocks_at_their_bounds(spark):
    rows = [(i, None, "en" if i < 512 else "de" if i < 1025 else "fr", i, f"A{i}") for i in range(1030)]
    assert _proved(spark.createDataFrame(rows, FULL).repartition(7)) == _plain(rows)


def test_manifest_of_odd_tables(spark):
    # Repeated rows, ids without value, several rows of one id.
    rows = [(1, "a", "en", 1, "X"), (1, "a", "en", 1, "X"), (1, "b", "en", 1, "Y"), (None, "a", "en", 1, "X"), (None, None, None, None, None), (2, "", "", 0, ""), (3, "a", "en", 2, "z" * 300_000)]
    assert _proved(spark.createDataFrame(rows, FULL)) == _plain(rows)
    assert _proved(spark.createDataFrame([], FULL)) == []
    # Columns of the input named like those the manifest makes, and with odd names.
    more = spark.createDataFrame(rows, FULL)
    for name in ("tree", "place", "digest", "item", "path", "block", "n", "leaf", "_at", "a.b", "c`d"):
        more = more.withColumn(name, F.lit(1))
    assert _proved(more) == _plain(rows)


def test_manifest_of_other_columns(spark):
    rows = spark.createDataFrame([(1, "k", 2.5), (2, "k", None)], "id long, `g.1` string, v double")
    got = manifest(rows, ["id", "v"], "g.1", "id").orderBy("doc_id").collect()
    leaves = [_h("1:1", "3:2.5"), _h("1:2", "-")]
    assert [r.leaf for r in got] == leaves
    assert {r.subroot for r in got} == {_h(*leaves)} == {r.root for r in got}


def _middle(rows):
    out = []
    for doc_id, text in rows:
        t = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((doc_id, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 80:
            out.append((doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", t))
        else:
            out.append((doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", t))
    return sorted(map(repr, out))


def test_middles(spark):
    odd = ["a", " a", "a ", "\x00 \x0b\x0c\r\n", "x<P>y", "x <M", "<S", "é\U0001f600 ü x  ", "< S> <", "tail \t\n", "w " * 30_000, "<" * 50, "S> P> M>"]
    rows = [*enumerate(texts(150, 4)), *((200 + i, t) for i, t in enumerate(odd * 8)), (None, "no id at all"), (7, "twice the same"), (7, "twice the same")]
    made = fill_in_middle(documents(spark, rows)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.collect()]
    assert sorted(map(repr, got)) == _middle(rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(documents(spark, [])).count() == 0
    clash = documents(spark, rows).select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("form"), F.lit(3).alias("a.b"))
    assert sorted(repr(tuple(r)) for r in fill_in_middle(clash).withColumn("back", restored(F.col("output"), F.col("form"))).collect()) == _middle(rows)


def test_lanes_reach_every_rank():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 256, 257, 4097, 5000):
        widths = [rng.randint(1, 9) for _ in range(n)]
        lanes = Lanes(__import__("numpy").array(widths, dtype="int64"))
        step = max(1, n // 400)
        assert [lanes.seek(k) for k in range(0, n + 1, step)] == [sum(widths[:k]) for k in range(0, n + 1, step)]
        assert lanes.seek(n) == sum(widths)
        # No lane is walked further than one stride.
        assert all(len(above[0]) * 16 >= len(below[0]) for below, above in zip(lanes.lanes, lanes.lanes[1:])) and len(lanes.lanes[-1][0]) <= 16


def test_draws_are_those_of_the_digest():
    assert draws(12, 42)[0] == int(hashlib.sha256(b"42:12").hexdigest()[:8], 16)


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [k for k in keys if k not in full]
        if not open_:
            return {k: most * sizes[k] for k in keys}
        level = (total - most * sum(sizes[k] for k in full)) / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > most * sizes[k]}
        if not over:
            return {k: most * sizes[k] if k in full else level * weight[k] for k in keys}
        full |= over


def _sources(n, seed=6):
    rng = random.Random(seed)
    names = ["web", "Web", "ähre", "zoo", None, ""]
    return [(i, rng.choices(names, [20, 5, 4, 3, 2, 2])[0], " ".join(["w"] * int(rng.paretovariate(0.9) + 1))[:20_000] if rng.random() > 0.05 else rng.choice([None, "", "  "])) for i in range(n)]


def test_mix(spark):
    rows = _sources(3000)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    got = mix_copies(df).collect()
    size = {i: len(SPACED.findall(t or "")) for i, _, t in rows}
    sizes = {}
    for i, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    targets = _targets(sizes)
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and r.taken == r.copies * r["size"]
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        # Copies are the expected ones, rounded down or up.
        assert abs(r.copies - targets[r.source] / sizes[r.source]) < 1
    longest = {s: max(size[i] for i, of, _ in rows if of == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= 2 * longest[s] for s in sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mix_copies(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_boundaries_crossed_are_those_of_the_sum(spark):
    rows = [(i, "a" if i < 700 else "b", "w " * (i % 7 + 1)) for i in range(1000)]
    got = mix_copies(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1, 1), share=0.7).collect()
    for s in ("a", "b"):
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r["size"], r.doc_id))
        expected, total = mine[0].target / mine[0].source_size, 0
        for k, r in enumerate(mine, 1):
            total += r.copies
            assert abs(total - k * expected) < 1 + 1e-5


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mix_copies(spark.createDataFrame([], schema)).count() == 0
    assert [(r.taken, r.target) for r in mix_copies(spark.createDataFrame([(1, "a", None), (2, None, " ")], schema)).collect()] == [(0, 0.0)] * 2
    same = [(None, None, "one two")] * 5 + [(3, "a", "x")] * 4
    df = spark.createDataFrame(same, schema).withColumns({"key": F.lit(1), "place": F.lit(2), "row": F.lit(3), "a.b": F.lit(4), "size": F.lit(5), "copies": F.lit(6)})
    got = mix_copies(df).collect()
    assert len(got) == 9 and all(r.copies in (1, 2) for r in got)
    out = mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    with pytest.raises(ValueError):
        mix_copies(df, share=3)


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 5, 10**6, rng.randint(1, 10**4)]) for i in range(300)} | {None: 77}
    rows = [("~" if s is None else f"={s}", n) for s, n in sizes.items()]
    got = {r.key: r.target for r in source_targets(spark.createDataFrame(rows, "key string, source_size long")).collect()}
    assert got == pytest.approx({"~" if s is None else f"={s}": t for s, t in _targets(sizes).items()})
