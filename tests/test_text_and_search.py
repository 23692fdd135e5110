import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightledger.operators.search import (
    best_hits,
    embed_missing,
    save_postings,
    search_embeddings,
    search_text,
    search_texts,
    term_counts,
    tfidf_index,
    weights,
    with_fallback,
)
from brightledger.operators.text import chunk, document_summary, extract_html, html_blocks, merge_neighbours, segment_text
from tests.conftest import as_dicts


def test_blocks_and_line_ranges(spark):
    def blocks(text, kind):
        df = spark.createDataFrame([(1, text)], "id long, text string")
        return [tuple(x) for x in segment_text(df, "id", "text", kind).first()["segments"]]

    assert blocks("a\nb\n\n\nc\n", "txt") == [("a\nb", None, 1, 2), ("c", None, 4, 5)]
    assert blocks("\n\n", "txt") == blocks(None, "txt") == blocks("", "md") == []
    assert blocks("a\r\n \u2003\nb", "txt") == [("a", None, 1, 1), ("b", None, 3, 3)]
    assert blocks("intro\n# One\n\nx\n## Two\ny", "md") == [("intro", None, 1, 1), ("x", "One", 3, 4), ("y", "Two", 6, 6)]
    assert blocks("import os\n\ndef f():\n    return 1\nclass A:\n    x = 1\n\n    y = 2", "py") == [
        ("import os", None, 1, 1), ("def f():\n    return 1", "def f", 3, 4), ("class A:\n    x = 1", "class A", 5, 6), ("y = 2", "class A", 8, 8),
    ]


def test_html_structure():
    html = (
        "<html><head><style>p{}</style><script>var x='<p>no</p>';</script></head><body><p>before</p><h2>Top <i>part</i></h2>"
        "<p>one<br>two<!-- hidden -->three</p><ul><li>item</li></ul><table><tr><th>k</th><td>v &amp; w</td></tr><tr><td></td></tr></table>"
        "<noscript><p>none</p></noscript><template><p>none</p></template></body></html>"
    )
    assert html_blocks(html) == [
        ("before", None, 1, 1),
        ("one two three", "Top part", None, None),
        ("item", "Top part", None, None),
        ("k  |  v & w", "Top part", None, None),
    ]


def test_unclosed_paragraph_holds_what_follows():
    assert html_blocks("<div><p>a<p>b</div><p>c") == [("a b", None, 1, 1), ("b", None, 2, 2), ("c", None, 3, 3)]


def test_html_without_text(spark):
    df = spark.createDataFrame([(1, "<script>x</script>"), (2, ""), (3, None)], "id long, html string")
    assert [r["segments"] for r in as_dicts(extract_html(df, "id", "html"))] == [[], [], []]


def python_chunks(parts):
    """Straightforward restatement used as the expected result."""
    out, buffer, place = [], None, None
    for text, where in parts:
        if len(text) > 800:
            if buffer is not None:
                out.append(buffer.strip())
                buffer = None
            start = 0
            while True:
                out.append(text[start : start + 800].strip())
                if start + 800 >= len(text):
                    break
                start += 700
        elif buffer is not None and place == where and len(buffer) + len(text) + 1 <= 800:
            buffer += "\n" + text
        else:
            if buffer is not None:
                out.append(buffer.strip())
            buffer, place = text, where
    return out + ([buffer.strip()] if buffer is not None else [])


def test_chunks_against_brute_force(spark):
    rng = random.Random(3)
    docs = {}
    for doc in range(12):
        sizes = [rng.choice([5, 100, 350, 700, 799, 800, 801, 1500, 1501, 2300]) for _ in range(rng.randint(0, 9))]
        docs[doc] = [("".join(rng.choice("abc é") for _ in range(n)).strip() or "x", rng.choice(["h1", "h1", "h2"])) for n in sizes]
    rows = [(doc, [(text, where, None, None) for text, where in parts]) for doc, parts in docs.items()]
    df = spark.createDataFrame(rows, "id long, segments array<struct<text:string,heading:string,line_start:int,line_end:int>>")
    got = {}
    for r in sorted(as_dicts(chunk(df, "id")), key=lambda r: (r["id"], r["chunk_index"])):
        assert r["chunk_id"] == f"{r['id']}_{r['chunk_index']}" and len(r["text"]) <= 800
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {doc: python_chunks(parts) for doc, parts in docs.items() if parts}
    summary = {r["id"]: (r["chunk_count"], r["char_count"]) for r in as_dicts(document_summary(chunk(df, "id"), "id"))}
    assert summary == {doc: (len(texts), sum(map(len, texts))) for doc, texts in got.items()}


def test_neighbours_merge_only_at_the_same_place(spark):
    rows = [(1, [("a", "h", None, None), ("b", "h", None, None), ("c", "i", None, None)])]
    df = spark.createDataFrame(rows, "id long, segments array<struct<text:string,heading:string,line_start:int,line_end:int>>")
    assert [s["text"] for s in as_dicts(merge_neighbours(df, "id"))[0]["segments"]] == ["a\nb", "c"]


def test_windows_overlap(spark):
    df = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(2000)))], "id long, text string")
    texts = [r["text"] for r in as_dicts(chunk(segment_text(df, "id", "text"), "id"))]
    assert [len(t) for t in texts] == [800, 800, 600] and texts[0][-100:] == texts[1][:100]


# --- search -----------------------------------------------------------------------------

TEXTS = {
    "1_0": "Revenue grew in the northern region and revenue is up",
    "2_0": "The HR policy covers vacation and leave",
    "3_0": "vacation Vacation VACATION a b c",
    "4_0": "",
}


def python_scores(texts, query, stops):
    words = {k: [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stops] for k, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(ws):
        v = {w: n * idf[w] for w, n in Counter(ws).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    q = unit([w for w in re.findall(r"\b\w\w+\b", query.lower()) if w not in stops])
    scores = {k: sum(x * q.get(w, 0) for w, x in unit(ws).items()) for k, ws in words.items()}
    return {k: round(s, 4) for k, s in scores.items() if s > 0}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")


def test_text_search(spark, chunks, tmp_path):
    stops = ["the", "and", "in", "is"]
    vocab, postings = tfidf_index(chunks, "chunk_id", "text", stops)
    queries = spark.createDataFrame([(1, "vacation policy"), (2, "revenue"), (3, "nothing here"), (4, "")], "query_id int, query string")
    save_postings(postings, str(tmp_path / "index"))
    for index in (postings, spark.read.parquet(str(tmp_path / "index"))):
        out = as_dicts(search_text(vocab, index, queries, 5, stops))
        for qid, query in ((1, "vacation policy"), (2, "revenue"), (3, "nothing here")):
            got = {r["chunk_id"]: r["relevance_score"] for r in out if r["query_id"] == qid}
            assert got == pytest.approx(python_scores(TEXTS, query, stops), abs=1e-4)
    only = search_text(vocab, postings, queries, 5, stops, spark.createDataFrame([("2_0",)], "chunk_id string"))
    assert {r["chunk_id"] for r in as_dicts(only)} == {"2_0"}


def test_default_stop_words_and_term_limit(spark, chunks):
    vocab, _ = tfidf_index(chunks, "chunk_id", "text", max_terms=2)
    assert [r["term"] for r in sorted(as_dicts(vocab), key=lambda r: r["term"])] == ["revenue", "vacation"]


def test_vector_search_against_numpy(spark, monkeypatch):
    import brightledger.operators.search as search

    rng = np.random.default_rng(5)
    data, asked = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(99, None)], "id long, v array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id int, vector array<double>")
    data32 = data.astype(np.float32).astype(float)
    cos = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (data32 / np.linalg.norm(data32, axis=1, keepdims=True)).T
    for block in (1 << 20, 100):
        monkeypatch.setattr(search, "BLOCK_BYTES", block)
        out = as_dicts(search_embeddings(vectors, "id", "v", queries, 4))
        for q in range(7):
            got = [r["chunk_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
            assert got == list(np.argsort(-cos[q])[:4])
    some = spark.createDataFrame([(3,), (4,)], "chunk_id long")
    assert {r["chunk_id"] for r in as_dicts(search_embeddings(vectors, "id", "v", queries, 4, some))} <= {3, 4}


def test_only_missing_chunks_are_embedded(spark, chunks):
    stored = spark.createDataFrame([("1_0",)], "chunk_id string")
    out = as_dicts(embed_missing(chunks, "chunk_id", "text", stored, lambda texts: [[float(len(t))] for t in texts]))
    assert {r["chunk_id"]: r["embedding"][0] for r in out} == {k: float(len(t)) for k, t in TEXTS.items() if k != "1_0"}


def test_fallback_per_query(spark):
    shape = "query_id int, rank int, chunk_id string, relevance_score double"
    first = spark.createDataFrame([(1, 1, "a", 0.9)], shape)
    second = spark.createDataFrame([(1, 1, "b", 0.5), (2, 1, "c", 0.4)], shape)
    got = {(r["query_id"], r["chunk_id"], r["method"]) for r in as_dicts(with_fallback(first, second))}
    assert got == {(1, "a", "embedding"), (2, "c", "tfidf")}


def test_pages_leave_python_in_small_slices():
    import brightledger.operators.text as text

    pages = pa.record_batch({"id": list(range(300)), "html": [f"<p>{i}</p><p>{'x' * 20_000}</p>" for i in range(300)]})
    split = lambda html: [dict(zip(("text", "heading", "line_start", "line_end"), part)) for part in html_blocks(html)]
    out = list(text._in_slices([pages], split))
    assert max(batch.nbytes for batch in out) < 2 * text.SLICE_CHARS
    assert pa.Table.from_batches(out).to_pydict() == {"id": list(range(300)), "segments": [split(html) for html in pages["html"].to_pylist()]}


@pytest.mark.parametrize("name", ["x9_html_chunks", "x9_html_part_chunks"])
def test_pages_pass_python_once(spark, name, capsys):
    import queries.documents as documents

    getattr(documents, name)(spark, "/root/testdata/sf0.001").explain()
    assert len(re.findall(r"\b(?:PythonMapInArrow|MapInArrow|MapInPandas)\b", capsys.readouterr().out)) == 1


def test_merged_pages_match_both_steps(spark):
    html = "<p>a</p><p>b</p><h2>T</h2><p>" + "x" * 500 + "</p><ul><li>y</li></ul><p>" + "z" * 900 + "</p><p>c</p>"
    df = spark.createDataFrame([(1, html), (None, html), (2, None), (3, "")], "id long, html string")
    apart = chunk(extract_html(df, "id", "html"), "id")
    once = chunk(extract_html(df, "id", "html", merged=True), "id", mergeable=False)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)


def test_words_are_counted_once_for_an_id(spark):
    rows = [(1, "Ab_1 ab_1, x! Größe-GRÖSSE"), (2, "one\ttwo\x0bone\x7f"), (1, "ab_1 \u00b2\u00b2 \U0001d7d8\U0001d7d8 \u4e2d\u6587 é ÉÉ"), (None, "one"), (None, "One two"), (3, None), (4, " . a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = df.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    wanted = words.filter("term <> 'two'").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = term_counts(df, "id", "text", ["two"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def brute_hits(spark, vocab, postings, asked, k):
    mine = weights(term_counts(asked, "query_id", "query", []), "query_id", vocab).withColumnRenamed("weight", "w")
    scores = postings.join(mine, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    return sorted(map(tuple, best_hits(scores, k).collect()), key=str)


@pytest.mark.parametrize("block, dense", [(1 << 18, 1 / 256), (40, 1 / 256), (40, 2.0), (1 << 18, 0.0)])
def test_block_search_matches_all_pairs(spark, monkeypatch, block, dense):
    import brightledger.operators.search as search

    monkeypatch.setattr(search, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(search, "DENSE_SHARE", dense)
    draw = random.Random(3)
    texts = [" ".join(f"w{min(draw.randrange(40), draw.randrange(40))}" for _ in range(draw.randrange(30))) for _ in range(90)]
    chunks = spark.createDataFrame([(i // 2 if i < 8 else i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (None, "w3"), (500, None), (501, texts[9]), (502, texts[9])], "chunk_id long, text string")
    asked = chunks.filter("chunk_id % 3 = 0 OR chunk_id IS NULL").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    vocab, postings = tfidf_index(chunks, "chunk_id", "text", [])
    wanted = brute_hits(spark, vocab, postings, asked, 4)
    assert len(wanted) > 100
    assert sorted(map(tuple, search_text(vocab, postings, asked, 4, []).collect()), key=str) == wanted
    assert sorted(map(tuple, search_texts(chunks, "chunk_id", "text", asked, 4, []).collect()), key=str) == wanted
    some = chunks.filter("chunk_id % 5 = 1 OR chunk_id IS NULL").select("chunk_id")
    within = brute_hits(spark, vocab, postings.join(some, "chunk_id", "left_semi"), asked, 4)
    assert sorted(map(tuple, search_texts(chunks, "chunk_id", "text", asked, 4, [], some).collect()), key=str) == within


def test_search_by_documents_shuffles_no_pairs(spark):
    """Documents of the same words: each pair of them shares each word."""
    same = " ".join(f"w{i}" for i in range(40))
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit(same + " u"), F.col("id")).alias("text"))
    asked = chunks.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))
    vocab, postings = tfidf_index(chunks, "chunk_id", "text", [])
    hits = search_text(vocab, postings, asked, 2, [])
    assert {(r["query_id"], r["chunk_id"]) for r in hits.filter("rank = 1").collect()} == {(i, i) for i in range(400)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [query_id" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packed_search_in_rounds(spark, monkeypatch, kind):
    import brightledger.operators.search as search

    for name, value in (("BLOCK_POSTINGS", 60), ("BLOCK_ROWS", 3), ("ROUND_POSTINGS", 50)):
        monkeypatch.setattr(search, name, value)
    draw = random.Random(8)
    texts = [" ".join(f"w{min(draw.randrange(30), draw.randrange(30))}" for _ in range(draw.randrange(20))) + " common" * draw.choice([0, 1, 300]) for _ in range(50)]
    chunks = spark.createDataFrame([(i // 2 if i < 6 else i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (700, None), (701, texts[9]), (702, texts[9])], "chunk_id long, text string")
    chunks = chunks.withColumn("chunk_id", F.col("chunk_id").cast(kind))
    asked = chunks.filter("chunk_id % 2 = 0 OR chunk_id IS NULL").select(F.col("chunk_id").alias("query_id"), F.concat("text", F.lit(" unknown")).alias("query"))
    vocab, postings = tfidf_index(chunks, "chunk_id", "text", [])
    wanted = brute_hits(spark, vocab, postings, asked, 3)
    assert len(wanted) > 60
    assert sorted(map(tuple, search_texts(chunks, "chunk_id", "text", asked, 3, []).collect()), key=str) == wanted
    assert search_texts(chunks, "chunk_id", "text", asked.limit(0), 3, []).count() == 0


def test_words_stay_packed(spark):
    import brightledger.operators.search as search

    same = " ".join(f"w{i}" for i in range(40))
    chunks = spark.range(400).coalesce(1).select("id", F.concat(F.lit(same + " u"), F.col("id")).alias("text"))
    rows = search._packed(chunks, "id", "text", []).collect()
    assert len(rows) == 1 + 40 + 400  # postings: 41 x 400
    assert sum(len(r["rows"]) + len(r["uses"]) for r in rows if r["term"]) == 3 * 41 * 400
