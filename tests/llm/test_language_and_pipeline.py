"""Class language model, quotation links, pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightledger.llm import class_lm, queries
from brightledger.llm.class_lm import score_documents
from brightledger.llm.quotes import _ordered, link_quotes
from tests.llm.helpers import LOW, SPACED, documents, texts
from tests.llm.test_duplicates import _linked, _removed
from tests.llm.test_quality_and_benchmarks import _contaminated


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CHUNK_TOKENS", 500)
    rows = [*enumerate(texts(80)), (3, "one two"), (None, "one")]
    got = score_documents(documents(spark, rows), classes=3, rounds=2).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = [(d, [*SPACED.findall((t or "").translate(LOW)), None]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = [(d, held(d), len(ws), sum(w in counts for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 6)) for d, ws in tokens]
    assert sorted(map(repr, ((*r[:5], round(r.base_score, 6)) for r in got))) == sorted(map(repr, want))
    assert all(r.score < 0 for r in got)
    assert score_documents(documents(spark, [])).count() == 0
    only_held = [(d, "a b") for d in range(200) if held(d)][:3]
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in score_documents(documents(spark, only_held)).collect())


def test_scores_from_the_classes_of_words(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CHUNK_TOKENS", 400)
    monkeypatch.setattr(class_lm, "PART_CHUNKS", 2)
    monkeypatch.setattr(class_lm, "BUCKET_WORDS", 40)
    rows = [*enumerate(texts(90, 12)), (3, "one two"), (None, "one")]
    docs, k = documents(spark, rows).coalesce(1), 3
    model = class_lm.train_classes(docs, classes=k, rounds=3)
    of_hash = {r.word: (r.n, r["class"]) for r in model.of_words().collect()}
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = [(d, SPACED.findall((t or "").translate(LOW))) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    hashes = lambda w: int(class_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0])
    assert {hashes(w): n for w, n in counts.items()} == {w: n for w, (n, _) in of_hash.items()}
    of_word = {w: of_hash[hashes(w)][1] for w in counts}
    assert all((of_word[w] == k) == (n < 2) for w, n in counts.items()) and set(of_word.values()) <= set(range(k + 1))
    rare, end = k, k + 1
    follow, sums, kinds = Counter(), Counter(), Counter(of_word.values())
    for w, n in counts.items():
        sums[of_word[w]] += n

    def contexts(ws):
        """(context, class) of each token and the end."""
        last, gap, out = end, False, []
        for w in [*ws, None]:
            c = end if w is None else of_word.get(w, rare)
            out.append(((last if last != end else "start", gap), c))
            last, gap = (last, True) if c == rare else (c, False)
        return out

    for d, ws in tokens:
        if not held(d):
            follow.update(contexts(ws))
    seen = Counter()
    for (context, _), n in follow.items():
        seen[context] += n

    def score(ws):
        total = 0.0
        for w, (context, c) in zip([*ws, None], contexts(ws)):
            total += math.log10((follow[context, c] + 0.1) / (seen[context] + 0.1 * (k + 2)))
            if c == rare:
                total += math.log10((counts[w] + 0.1) / (sums[rare] + 0.1 * (kinds[rare] + 1)))
            elif w is not None:
                total += math.log10(counts[w] / sums[c])
        return round(total, 6)

    got = score_documents(docs, classes=k, rounds=3).collect()
    have, want = sorted((str(r.doc_id), r.score) for r in got), sorted((str(d), score(ws)) for d, ws in tokens)
    assert [d for d, _ in have] == [d for d, _ in want] and [x for _, x in have] == pytest.approx([x for _, x in want], abs=1e-5)


def test_classes_help_on_held_out_texts(spark):
    rng = random.Random(9)
    tongues = [[f"{p}{i}" for i in range(40)] for p in "xyz"]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=60))) for i in range(600)]
    scored = score_documents(documents(spark, rows), classes=6, rounds=8).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # Unigrams can't know the language; classes save nearly log10(3) a word.
    assert scored[0] - scored[1] > 0.3 * scored[2]


def test_rare_words_of_a_large_corpus_get_classes(spark, monkeypatch):
    # Some four uses a word in 2.8 million tokens, most of them one word's.
    monkeypatch.setattr(class_lm, "CHUNK_TOKENS", 200_000)
    monkeypatch.setattr(class_lm, "BUCKET_WORDS", 100, raising=False)
    rng = random.Random(5)
    rows = [(i, "the " * 4000) for i in range(1000, 1700)]
    kinds = [[f"{p}{i}" for i in range(300)] for p in "xy"]
    for i in range(60):
        rows.append((i, " ".join(f"{rng.choice(kinds[i % 2])}" for _ in range(80))))
    got = score_documents(documents(spark, rows), classes=4).where("held_out and doc_id < 1000").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # One class of all 600 words costs log10(600) a word, one for each kind log10(300).
    assert -got[0] / got[2] < 2.7, got


def test_quotation_links(spark):
    rows = [
        (1, 0, "a", "Hello  there.\nSecond line", "x"),
        (1, 1, "b", "> hello there.\n> Second line\nMine", "x"),
        (1, 2, "a", ">> Hello there.\n>> Second line\n> Mine\nThanks", "x"),
        (1, 3, "c", "> Hello there. Second line\nOther branch", "x"),
        (1, 4, "c", "> never said\nNew thread", "x"),
        (1, 5, "d", "> Mine\n\nanswer one\n> Thanks\nanswer two", "x"),
        (1, 6, "d", "> answer two\n", "x"),
        (2, 0, "a", "> Mine\nin another conversation", "x"),
        (2, 1, None, None, "x"),
        (2, 2, "a", "", "x"),
        (None, 0, "a", "> Mine\nlost", "x"),
        (3, None, "a", "> Mine\nlost", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, quoted string")
    got = {(r.conv_id, r.turn): r for r in link_quotes(frame).collect()}
    assert len(got) == len(rows)
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {k: {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 5): 2, (1, 6): 5}.get(k) for k in parents}
    assert got[1, 1].text == "Mine" and got[1, 5].text == "answer one\nanswer two" and got[1, 6].text == "" and got[2, 1].text == ""
    assert (got[1, 2].n_quotes, got[1, 2].n_linked) == (2, 2) and (got[1, 4].n_quotes, got[1, 4].n_linked) == (1, 0)
    assert got[1, 6].depth == 4 and got[1, 6].root_turn == 0
    order = [t for (c, t), _ in sorted(((k, r) for k, r in got.items() if k[0] == 1), key=lambda x: x[1].reply_order)]
    assert order == [0, 1, 2, 5, 6, 3, 4]
    assert link_quotes(frame.limit(0)).count() == 0
    assert link_quotes(frame.union(frame)).count() == 2 * len(rows)
    deep = "\n".join(">" * k + f" level {k}" for k in range(60, 0, -1)) + "\nown " * 20_000
    assert link_quotes(spark.createDataFrame([(1, 0, "a", deep)], "conv_id long, turn long, role string, text string")).first().n_quotes == 60


def test_quoted_parts_are_linked(spark):
    rows = [
        (1, 0, "a", "Dear all,\n\nfirst paragraph\nof two lines\n\nsecond paragraph"),
        (1, 1, "b", "> first paragraph\n> of two lines\nOne paragraph answered"),
        (1, 2, "c", "> of two lines\nOne line answered"),
        (1, 3, "d", "> Dear all,\n\n> second paragraph\nNo mark on the blank line"),
        (1, 4, "e", "> One line answered\nyes\n> not his\nno"),
        (1, 5, "f", "Dear all,\nsecond paragraph"),
        (1, 6, "g", "> Dear all,\n> second paragraph\nThe longest match is of turn five"),
        (1, 7, "h", "> unheard of\n> \n> No mark on the blank line\nPart of a passage"),
    ]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r.parent_turn for t, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 0, 4: 2, 5: None, 6: 5, 7: 3}
    assert (got[4].n_quotes, got[4].n_linked) == (2, 1) and (got[7].n_quotes, got[7].n_linked) == (1, 1)


def test_long_chains_and_wide_threads_are_ordered(spark):
    rng = random.Random(4)
    parent = {0: None}
    for t in range(1, 900):
        # A chain of 600 answers, then answers to anything, some with no parent.
        parent[t] = t - 1 if t < 600 else rng.choice([None, rng.randrange(t), 3])
    nodes = spark.createDataFrame([(c, t, p, 0) for c in (1, 2) for t, p in parent.items()], "conv_id long, turn long, parent_turn long, n_linked long")
    got = {(r.conv_id, r.turn): r for r in _ordered(nodes.repartition(3)).collect()}
    answers = {}
    for t, p in parent.items():
        answers.setdefault(p, []).append(t)
    order, open_ = [], [(t, 0, t) for t in reversed(answers[None])]
    while open_:
        t, depth, root = open_.pop()
        order.append((t, depth, root))
        open_ += [(a, depth + 1, root) for a in reversed(answers.get(t, []))]
    for c in (1, 2):
        for i, (t, depth, root) in enumerate(order):
            r = got[c, t]
            assert (r.reply_order, r.depth, r.root_turn) == (i, depth, root)


def test_every_operator_has_a_query():
    names = {f"op{n}" for n in range(1, 14)}
    assert {n.split("_")[0] for n in queries.QUERIES} == names and [n for n, _ in corpus_pipeline.STAGES][1] == "near duplicates"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Clean documents, junk, copies, near copies, a shared passage, benchmark
    items, rows that repeat and rows without id or text."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(n // 12)) + "."
    passage, items = prose(70), [prose(36) for _ in range(5)]
    rows = [(i, prose(rng.randint(60, 400))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    rows += [(230 + i, rows[i][1].replace(".", "", 1)) for i in range(10)]
    rows += [(260 + i, f"{prose(80)} {passage} {prose(80)}") for i in range(6)]
    rows += [(280 + i, f"{prose(120)} {items[i]} {prose(60)}") for i in range(5)]
    rows += [(300 + i, " ".join(w + "%%%" for w in rng.choices(words, k=100))) for i in range(10)]
    rows += [(320, "too short"), (321, None), (322, ""), (None, prose(150)), rows[50], rows[50]]
    rng.shuffle(rows)
    out = tmp_path_factory.mktemp("corpus")
    ids, text = zip(*rows)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(text, pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([None if t is None else len(t) for t in text], pa.int64()), "class": ["clash"] * len(rows)}), out / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(5), pa.int64()), "text": items}), out / "benchmark.parquet")
    return str(out), rows, items


def test_pipeline_by_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    docs = stages["quality rules"](spark, docs, path)
    kept = read(docs)
    assert docs.columns == columns and kept == sorted(((d, t) for d, t in rows if t and len(t.split()) >= 10 and "%%%" not in t), key=repr)

    docs = stages["near duplicates"](spark, docs, path)
    some = sorted({r for r in kept if r[0] is not None})
    want = [r for r, (_, _, _, first) in zip(some, _linked(some, 5)) if first] + [r for r in kept if r[0] is None]
    kept = read(docs)
    assert docs.columns == columns and kept == sorted(want, key=repr) and len(want) < len(some)

    docs = stages["suffix-array dedup"](spark, docs, path)
    lengths = {d: n - gone for d, n, gone, _, _ in _removed(kept)}
    done = read(docs)
    assert docs.columns == columns and {d: len(t) for d, t in done} == lengths and sum(lengths.values()) < sum(len(t) for _, t in kept)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = stages["benchmark decontamination"](spark, docs, path)
    clean = {d for d, *_, bad in _contaminated(done, list(enumerate(items))) if not bad}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == clean == {d for d, _ in done} - {280 + i for i in range(5)}

    pieces = stages["packing"](spark, docs, path)
    assert {r.doc_id for r in pieces.collect()} == clean


def test_pipeline_run(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_with_columns_of_odd_names(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = ["_block", "a.b", "c`d", "row", "doc", "_b0", "b0", "at", "class", "spans", "kept", "n"]
    for i, name in enumerate(odd):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{i}-{r.doc_id}") for i, c in enumerate(odd)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0
