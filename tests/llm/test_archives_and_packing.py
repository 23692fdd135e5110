"""ZIP-packaged web archives, packing."""

import base64
import hashlib
import io
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brightledger.llm.packing import ByteTokenizer, pack
from brightledger.llm.warc_zip import ARCHIVE, INDEX, data_start, directory, parse_record, read_archives, record, stored_zip, write_archives
from tests.llm.helpers import documents, texts


def test_zip_round_trips():
    members = [("a/é.txt", b"one"), ("empty", b""), ("z", bytes(range(256)) * 50)]
    data = stored_zip(members)
    with zipfile.ZipFile(io.BytesIO(data)) as other:
        assert other.testzip() is None
        assert [(n, other.read(n)) for n in other.namelist()] == members
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as other:
        for name, content in members:
            other.writestr(name, content)
        other.comment = b"note PK\5\6 " + b"x" * 40
    for whole in (data, out.getvalue()):
        file = io.BytesIO(whole)
        found = directory(file, len(whole))
        assert [(m.name, whole[data_start(file, m) :][: m.size]) for m in found] == members
    with pytest.raises(ValueError):
        directory(io.BytesIO(data[:-30]), len(data) - 30)
    with pytest.raises(ValueError):
        directory(io.BytesIO(b""), 0)


def test_zip_of_many_or_packed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as other:
        for i in range(66_000):
            other.writestr(zipfile.ZipInfo(str(i)), b"")
        other.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    whole = out.getvalue()
    found = directory(io.BytesIO(whole), len(whole))
    assert [m.name for m in found] == [*map(str, range(66_000)), "packed"]
    with pytest.raises(ValueError, match="compressed"):
        data_start(io.BytesIO(whole), found[-1])


def test_records():
    warc, http, payload = parse_record(record(5, "http://a/ü\r\nX: y", b"\r\n\r\nbody", 8, "D", None))
    assert payload == b"\r\n\r\nbody" and warc["warc-type"] == "response" and http["content-length"] == "8" and "x" not in warc
    warc, http, payload = parse_record(record(None, None, None, 8, "D", 7))
    assert payload == b"" and warc["warc-refers-to"] == "<urn:page:7>" and "warc-target-uri" not in warc


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, least):
    html = [None, "", "same", "same", "abc", "abc", "ünï", "x" * 5000, "last"]
    rows = [(i, f"http://h/{i}\n" if i % 2 else None, h, "clash") for i, h in enumerate(html * 2)] + [(17, "u", "last", "again"), (None, "u", "same", "c"), (None, "u", "own", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    manifest = write_archives(pages, min_payload=least, package_bytes=500)
    got = read_archives(manifest, batch_records=3).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) == len(got) and manifest.count() > 3
    keepers = defaultdict(list)
    for i, _, h, _ in rows:
        keepers[(h or "").encode()].append(i)
    want = []
    for i, u, h, _ in rows:
        payload = (h or "").encode()
        ids = [x for x in keepers[payload] if x is not None]
        keeper = max(ids) if ids and len(payload) >= least and len(keepers[payload]) > 1 else i
        revisit = i is not None and i != keeper
        want.append((i, u, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_members_of_a_package(spark):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    path = write_archives(pages).first().path.removeprefix("file:")
    with zipfile.ZipFile(path) as package:
        assert package.namelist() == [ARCHIVE, INDEX] and all(m.compress_type == 0 for m in package.infolist())


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_as_the_library():
    library, mine = Tokenizer.from_file(PATH), ByteTokenizer(PATH)
    for text in [t for t in texts(80) if t is not None] + ["a<|endoftext|> b", "don't  \n\n x\t1234 ü日本🙂", "\u0000\u200b", "a" * 3000, " " * 500]:
        assert mine.ids(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("length", "windows", "group"), [(64, 2, 1), (64, 5, 8), (2048, 32, 32)])
def test_packing(spark, length, windows, group):
    rows = [*enumerate(texts()), (3, "one"), (None, "no id"), (70, "word " * 3000)]
    docs = documents(spark, rows)
    pieces = pack(docs, PATH, length, windows, group).collect()
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        assert sum(p.length for p in parts) == sum(map(len, want[i]))
        for p in parts:
            assert p.length > 0 and any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in want[i])
        if len(want[i]) == 1:
            at = 0
            for p in sorted(parts, key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(want[i][0])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        # Nothing is padded: whole sequences, or a power of two.
        assert at == length or at < length and at & (at - 1) == 0
    assert pack(docs.limit(0), PATH).count() == 0
