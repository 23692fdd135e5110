"""Quality rules, decontamination."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightledger.llm import quality
from brightledger.llm.decontaminate import contamination, find_windows
from brightledger.llm.quality import fit_votes, judge_quality, rules
from tests.llm.helpers import ALNUM, DOCS, LOW, SPACED, documents, texts


def _base(text):
    text = text or ""
    words = SPACED.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rows = [*enumerate(texts(80)), *enumerate(["# * 🙂 <b>|", "a b c d e " * 40, "\x0b\x0c\r", "x " * 4000, "l\n l\nl\n\nl"], 100), (5, "again"), (None, None)]
    docs = documents(spark, rows).withColumn("n_words", F.lit("clash"))
    got = judge_quality(docs, carry=True).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) == sorted(repr((i, *_base(t))) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) and r.row.n_words == "clash"
    assert judge_quality(docs.limit(0)).count() == 0


def _plain_fit(rows, rounds=400):
    """Expectation-maximisation document by document, in logarithms."""
    votes = np.array(rows)
    good = (1 + (votes > 0).sum(axis=1)) / (2 + (votes != 0).sum(axis=1))
    for _ in range(rounds):
        share = (good.sum() + 1) / (len(rows) + 2)
        right_good = ((good[:, None] * (votes > 0)).sum(axis=0) + 1) / ((good[:, None] * (votes != 0)).sum(axis=0) + 2)
        bad = 1 - good
        right_bad = ((bad[:, None] * (votes < 0)).sum(axis=0) + 1) / ((bad[:, None] * (votes != 0)).sum(axis=0) + 2)
        log_good = np.log(share) + np.where(votes > 0, np.log(right_good), np.where(votes < 0, np.log(1 - right_good), 0)).sum(axis=1)
        log_bad = np.log(1 - share) + np.where(votes < 0, np.log(right_bad), np.where(votes > 0, np.log(1 - right_bad), 0)).sum(axis=1)
        good = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
    return share, right_good, right_bad, good


def test_a_noisy_rule_is_outvoted():
    rng = random.Random(3)
    rows = []
    for i in range(1000):
        truth = -1 if i < 100 else 1
        sure = lambda: truth if rng.random() < 0.97 else rng.choice([0, -truth])  # noqa: B023, E731
        rows.append((sure(), sure(), sure(), -1 if rng.random() < 0.4 else 1))
    share, accuracies = fit_votes(sorted(Counter(rows).items()))
    assert abs(share - 0.9) < 0.02
    # Estimated near what it is: right on 60 % of the good, on 40 % of the bad.
    assert abs(accuracies[3][0] - 0.6) < 0.04 and abs(accuracies[3][1] - 0.4) < 0.12
    assert all(g > 0.95 and b > 0.85 for g, b in accuracies[:3])
    kept = lambda votes: quality._posterior(share, accuracies, votes) >= 0.5
    assert kept((1, 1, 1, -1)) and kept((1, 1, 0, -1)) and not kept((-1, -1, -1, 1)) and not kept((-1, -1, 0, 1))


def test_fit_is_that_of_documents_one_by_one(spark):
    rows = [(i, t) for i, t in enumerate(texts(300, 11))]
    rows += [(1000 + i, " | ".join(f"w{j}" for j in range(i, i + 40))) for i in range(60)]
    judged = [r for r in judge_quality(documents(spark, rows)).collect() if not r.base_failed]
    *_, good = _plain_fit([[r[f"vote_{k}"] for k in rules()] for r in judged])
    assert [r.p_good for r in judged] == pytest.approx(good.tolist(), abs=1e-6)
    assert [r.kept for r in judged] == [g >= 0.5 for g in good]
    assert fit_votes([]) == (0.5, [])


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = judge_quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def _contaminated(docs, items, window=10):
    windows = {}
    for i, t in items:
        words = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        words, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [4, 100_000])
def test_contamination(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 9, 10, 12, 30])))) for i in range(12)] + [(90, None), (91, "..."), (92, "w1, W2"), (93, "w1 w2")]
    rows = [*enumerate(texts(20)), (3, "W1-w2 w3"), (None, "w1 w2")]
    for i in range(40):
        parts = rng.choices(words, k=rng.randint(1, 200))
        if rng.random() < 0.6:
            item = rng.choice(items)[1] or ""
            parts[rng.randrange(len(parts)) :] = [item.upper() + "!", *parts[-3:]]
        rows.append((200 + i, " ".join(parts)))
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, bench, block_windows=block).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _contaminated(rows, items)))
    if block == 4:
        return
    assert contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in contamination(docs, bench.limit(0)).collect())
    carried = find_windows(docs.withColumn("spans", F.lit("clash")), bench, carry=True)
    assert {r.row.spans for r in carried.collect()} == {"clash"}


def test_long_text(spark):
    text = "filler " * 60_000 + " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, text)], DOCS)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10)))], "item_id long, text string")
    assert tuple(contamination(docs, bench).first())[:4] == (1, 60_010, 10, 1)


def test_item_ids_of_any_kind(spark):
    docs = documents(spark, [(1, "x one two three four"), (2, "nothing here")])
    bench = spark.createDataFrame([("q-10", "one two three"), ("q-9", "two three four"), (None, "nothing")], "item_id string, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert got[1].n_items == 2 and got[1].items_sha256 == hashlib.sha256(b"q-10,q-9").hexdigest() and got[1].n_hit == 4
