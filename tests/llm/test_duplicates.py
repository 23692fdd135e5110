"""Near duplicates, repeated strings, components."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightledger.llm import near_dup, suffix_dedup
from brightledger.llm.graph import components
from brightledger.llm.near_dup import near_duplicates
from brightledger.llm.suffix_dedup import merged_blocks, remove_repeats, repeat_counts, repeats
from tests.llm.helpers import DOCS, LOW, SPACED, documents, texts


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame([*edges, (7, 7)], "a long, b long")).collect()}
    assert got == {n: root(n) for n in up if n in got} and set(got) >= {n for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _linked(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "block"), [(4, 2000), (5, 3)])
def test_near_duplicates(spark, size, block):
    rng = random.Random(size)
    rows = list(enumerate(texts(70, seed=4)))
    base = " ".join(f"t{rng.randrange(500)}" for _ in range(300))
    for i in range(40):  # one large group of near copies, some of them too far from each other
        parts = base.split()
        for _ in range(rng.randint(0, 9)):
            parts[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(parts)))
    rng.shuffle(rows)
    docs = documents(spark, rows).withColumn("class", F.lit("clash"))
    got = near_duplicates(docs, size=size, block_classes=block).collect()
    assert sorted(map(tuple, got)) == sorted(_linked(rows, size))


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (4, "A B C D E F"), (5, None), (6, ""), (7, "x"), (8, "X")]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), size=4).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(None, 3, None, True), (9, 3, 4, False), (9, 3, 4, False), (4, 3, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False)])
    )
    assert near_duplicates(documents(spark, [])).count() == 0


def test_match_threshold_loses_few_pairs():
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        shared, own = rng.integers(0, 2**64, 200, dtype=np.uint64), rng.integers(0, 2**64, 50, dtype=np.uint64)
        sets = [np.unique(np.concatenate([shared, own[:25]])), np.unique(np.concatenate([shared, own[25:]]))]
        assert near_dup.similar(*sets, 80)
        values = near_dup._signatures(sets, near_dup.COORDINATES)[1]
        lost += np.count_nonzero(values[0] == values[1]) < near_dup.MATCHES
    assert lost == 0


def test_merged_order_and_blocks():
    rng = random.Random(3)
    for alphabet, n in ((b"a", 6), (b"ab", 12), (bytes(range(256)), 9)):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(100, 260))) for _ in range(n)]
        strings += [strings[0], strings[1][20:] + strings[2][:90]]
        string, place, block = merged_blocks(strings, shards=3)
        assert sorted(zip(string.tolist(), place.tolist())) == [(s, p) for s in range(len(strings)) for p in range(len(strings[s]) + 1)]
        heads = [strings[s][p : p + 100] for s, p in zip(string, place)]
        whole = [len(h) == 100 for h in heads]
        assert [h for h, w in zip(heads, whole) if w] == sorted(h for h, w in zip(heads, whole) if w)
        ids = {}
        for h, w, b in zip(heads, whole, block.tolist()):
            if w:
                assert ids.setdefault(h, b) == b
        assert len(set(ids.values())) == len(ids)


def test_repeats_of_one_string():
    doc, start = repeats([b"ab" * 75], np.array([4]), np.array([10]))
    assert set(doc.tolist()) == {4} and sorted(start.tolist()) == list(range(12, 61))


def _removed(rows, length=100):
    earliest, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (-1 if rows[i][0] is None else rows[i][0]))
    for i in order:
        d, data = -1 if rows[i][0] is None else rows[i][0], (rows[i][1] or "").encode()
        for s in range(len(data) - length + 1):
            earliest.setdefault(data[s : s + length], (d, s))
    for i, t in rows:
        d, data = -1 if i is None else i, (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if earliest[data[s : s + length]] != (d, s):
                gone[s : s + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 2000])
def test_removed_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    rng = random.Random(8)
    rows = list(enumerate(texts(70, seed=6, words=60)))
    passage = "".join(rng.choices("ab cé", k=400))
    rows += [(300 + i, "".join(rng.choices("xyz ", k=rng.randint(0, 90))) + passage[rng.randint(0, 200) :] + str(i)) for i in range(25)]
    rows += [(400, " " * 700), (401, "ab" * 300 + "c"), (402, passage[:99]), (403, passage[:100]), (None, passage), (404, "🙂" * 120)]
    docs = documents(spark, rows).withColumn("runs", F.lit("clash"))
    assert sorted(map(repr, map(tuple, repeat_counts(docs).collect()))) == sorted(map(repr, _removed(rows)))


def test_removed_repeats_of_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    same = spark.createDataFrame([(1, text), (1, text), (2, text)], DOCS)
    assert sorted((r.doc_id, r.n_removed) for r in repeat_counts(same).collect()) == [(1, 0), (1, 0), (2, 150)]
    assert repeat_counts(documents(spark, [])).count() == 0
    # A character of which a byte is removed goes from the text.
    a, b = "x" + "é" * 60, "y" + "ã" + "é" * 60
    docs = spark.createDataFrame([(1, a, 5), (2, b, 6)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in remove_repeats(docs, carry=True).collect()}
    assert got[2].row.spans == 6 and got[2].kept_text.startswith("yã") and bytes(got[2].kept).startswith("yã".encode())


def test_pieces_hold_every_string_once():
    rng = random.Random(4)
    rows = [bytes(rng.choices(b"ab", k=n)) for n in (0, 99, 100, 250, 900)] + [b"q" * 9000]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    text, starts, counts, least, twice = suffix_dedup.pieces(data, offsets)
    places = sorted((t, s - offsets[t] + k) for t, s, n in zip(text, starts, counts) for k in range(n))
    assert places == [(t, k) for t, r in enumerate(rows) for k in range(len(r) - 99)]
    assert counts.max() <= suffix_dedup.PIECE and twice[text == 5].all()


def test_removed_repeats_of_every_period(spark):
    rng = random.Random(12)
    rows = []
    for period in range(1, 111):
        for size in (period + 99, period + 100, 3 * period + 130):  # a unit of its own, so that its pieces meet no others
            unit = "".join(rng.choices("abcdefghijklmnop", k=period))
            rows.append((len(rows), (unit * (size // period + 1))[:size]))
    assert sorted(map(tuple, repeat_counts(documents(spark, rows)).collect())) == sorted(_removed(rows))


def _unlike_around(n, seed=21):
    """One passage between bytes that no other text has."""
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdefghijkl ", k=140))
    return passage, ["".join(rng.choices("0123456789", k=140)) + passage + "".join(rng.choices("0123456789", k=120)) for _ in range(n)]


def test_strings_of_hot_buckets_leave_a_task_once():
    passage, rows = _unlike_around(400)
    wanted = [[{"bucket": 1, "start": 140, "n": 41, "hot": True}]] * len(rows)
    ids = [i * 7 % 400 for i in range(400)]
    kind = pa.list_(pa.struct([("bucket", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(wanted, kind)], ["doc", "text", "wanted"])
    out = [r for b in suffix_dedup._extract(100)(iter([batch])) for r in b.to_pylist()]
    sent = [r for r in out if r["piece"] is not None]
    assert sorted((r["doc"], r["start"], r["piece"].decode()) for r in sent) == [(0, 140 + k, passage[k : k + 100]) for k in range(41)]
    assert sorted((r["doc"], r["start"], r["n"]) for r in out if r["piece"] is None) == [(i, 140, 41) for i in range(1, 400)]


def test_one_hot_string_is_not_held(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "merged_blocks", None)
    n, held = 3000, []
    fields = [(c, pa.int64()) for c in ("bucket", "digest", "doc", "start", "n")]
    schema = pa.schema([*fields, ("piece", pa.binary())])

    def batches():
        for low in range(0, n, 500):
            yield pa.RecordBatch.from_arrays([pa.array([x] * 500) for x in (0, 5)] + [pa.array(range(low, low + 500)), pa.array([3] * 500), pa.array([1] * 500), pa.array([b"q" * 100] * 500, pa.binary())], schema=schema)

    for out in suffix_dedup._merge(100)(batches()):
        held += zip(*(out.column(i).to_pylist() for i in range(3)))
    assert held == [(i, 3, 1) for i in range(1, n)]


@pytest.mark.parametrize("limit", ["HOT_PIECES", "HOT_BYTES"])
def test_hot_buckets_of_many_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, limit, 20)
    monkeypatch.setattr(suffix_dedup, "HELD_STRINGS", 300)  # so that tasks send equal strings more than once
    rows = list(enumerate(_unlike_around(90)[1]))
    rows += [(200, None), (201, "ab" * 400), (202, "ab" * 300 + "c"), (203, rows[5][1])]
    assert sorted(map(tuple, repeat_counts(documents(spark, rows)).collect())) == sorted(_removed(rows))


def test_only_shared_parts_are_merged(monkeypatch):
    seen = []
    monkeypatch.setattr(suffix_dedup, "merged_blocks", lambda strings, **o: seen.extend(strings) or merged_blocks(strings, **o))
    passage, rows = _unlike_around(3)
    doc, start = repeats([r.encode() for r in rows] + [bytes(range(150))], np.arange(4), np.zeros(4, np.int64))
    assert seen == [passage.encode()] * 3
    assert sorted(zip(doc.tolist(), start.tolist())) == [(i, 140 + k) for i in (1, 2) for k in range(41)]
    assert all(map(np.array_equal, repeats([b"x" * 99], np.arange(1), np.arange(1)), ([], [])))
