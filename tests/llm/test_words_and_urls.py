"""Arrays of words, URL filter, token counts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, models, pre_tokenizers

from brightledger.llm import arrays
from brightledger.llm.token_counts import Counter, count_tokens, vocabulary
from brightledger.llm.url_filter import bloom_blocks, judge_urls, listed, not_listed, possible
from tests.llm.helpers import ALNUM, DOCS, LOW, SPACED, documents, texts


def test_words_of_many_texts():
    rows = texts()
    column = pa.array(["skipped", *rows]).slice(1)
    for table, pattern in ((arrays.SPACED, SPACED), (arrays.ALPHANUMERIC, ALNUM)):
        data, offsets = arrays.text_bytes(column)
        data = arrays.LOWER[data]
        starts, ends, counts = arrays.word_bounds(data, offsets, table)
        whole = data.tobytes()
        want = [pattern.findall((t or "").translate(LOW)) for t in rows]
        assert counts.tolist() == [len(w) for w in want]
        flat = [w.encode() for words in want for w in words]
        assert [whole[s:e] for s, e in zip(starts, ends)] == flat
        hashes = arrays.word_hashes(data, starts, ends)
        assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(hashes.tolist(), flat)))


def test_slices_are_bounded_and_complete():
    batch = pa.record_batch({"n": pa.array(range(50)), "text": pa.array(["x" * (i % 7 * 100) if i % 5 else None for i in range(50)])})
    parts = list(arrays.slices([batch, batch.slice(0, 0)], limit=1000))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in parts)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/x", "block")]
URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "http://example.net/EN/1", "https://net/", "http://net", "http://internet/", "ftp://b.org/fr/x", "http://org/fr",
    "http://www.example.com/de/1", "http://www.example.com:80/de/1#top", "http://u@www.example.com./de/1", "http://other.com/de/1", "http://a.org?q=/fr/", "x://y://z/net", "http:///p",
]


def _judge(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark)[0]
    host = host.translate(LOW)
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_judged_urls(spark):
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(URLS * 2)], "page_id long, url string, host int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r.page_id: r for r in judge_urls(pages, rules, max_blocks=2).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        host, path, rule, action = _judge(url)
        r = got[i]
        assert (r.url, r.host, r.path, r.rule) == (url, host, path, rule)
        other_spelling = url in ("http://net", "http://www.example.com:80/de/1#top", "http://u@www.example.com./de/1")
        assert r.verdict == (action or ("block" if other_spelling else "allow")), url
    blocklist = spark.createDataFrame([("other.com/de/1",), (None,)], "canonical string")
    assert {r.url for r in judge_urls(pages, rules, blocklist).where("listed").collect()} >= {"http://other.com/de/1"}
    empty = pages.limit(0)
    assert judge_urls(empty, rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 5000, 7).selectExpr("cast(id as string) key")
    rows = spark.range(5000).selectExpr("case when id % 11 > 0 then cast(id as string) end key", "id")
    want = {i for i in range(0, 5000, 7) if i % 11}
    for blocks in (1, 64, 1 << 16):
        near = {r.id for r in possible(rows, "key", bloom_blocks(keys, "key", blocks), blocks).collect()}
        assert want <= near
        assert {r.id for r in listed(rows, "key", keys, blocks).collect()} == want
        assert {r.id for r in not_listed(rows, "key", keys, blocks).collect()} == set(range(5000)) - want
    assert len(near) < len(want) * 1.1
    assert possible(rows, "key", bloom_blocks(keys.limit(0), "key")).count() == 0


def _reference(pieces, unknown=0, fallback=True):
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


HARD = ["", " ", "  a", "a  b ", "a\nb\tc", "▁a ▁", "日本語 text 🙂🙂", "x" * 300, "\u0000a", "aaaa abab", "é è"]


def test_token_counts_as_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(path)
    reference = _reference(pieces)
    rows = [*enumerate([*HARD, *(t for t in texts(40) if t)]), (99, None), (99, None)]
    got = count_tokens(spark.createDataFrame(rows, DOCS), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(reference.encode(t or "").ids)) for i, t in rows)
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in rows)
    assert count_tokens(documents(spark, []), path).count() == 0


def test_ties_and_unknown_characters():
    rng = np.random.default_rng(3)
    letters = "abc▁"
    for fallback in (False, True):
        pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -9.0) for b in range(256) if fallback]
        seen = {"".join(rng.choice(list(letters), rng.integers(1, 5))) for _ in range(30)}
        # Scores that tie in many ways.
        pieces += [(p, -float(rng.integers(1, 4))) for p in sorted(seen)]
        reference, counter = _reference(pieces, fallback=fallback), Counter(pieces)
        for _ in range(400):
            text = "".join(rng.choice(list("abcdé "), rng.integers(0, 25)))
            assert counter.text(text) == len(reference.encode(text).ids), (text, fallback)
