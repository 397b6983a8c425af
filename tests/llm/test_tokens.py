import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD
from tokenizers import Tokenizer

from scoreline.llm import flat_ids, packing, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer(spark, plain, monkeypatch):
    texts = [*ODD, "It's we've they'll I'd don't 'tis 's", "a.b,c. ,.; x,. ..., é. ÉCOLE. ß, µm ªº ÿŸ", "é café. Å ﬁ", "tab\tnew\nline\r\n\x0b\x0c end"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = token_ids.Encoder(PATH)
    assert enc.apart and enc.direct
    for cap in (10**6, 20):
        monkeypatch.setattr(token_ids, "KEPT_WORDS", cap)
        for k in range(0, len(texts), 7):
            for t, ids in zip(texts[k : k + 7], enc.encode(texts[k : k + 7], 1), strict=True):
                assert np.frombuffer(ids, enc.dtype).tolist() == plain(t, 1), t


def test_encoder_keeps_stops_with_marks_that_normalising_makes(plain):
    ends = [c for c in map(chr, [*range(0xAA, 0xD800), *range(0xE000, 0x20000)]) if c.isalpha() and len(unicodedata.normalize("NFC", c).lower()) > 1]
    assert "\u0130" in ends and "\u0958" in ends
    texts = ["BELED\u0130YES\u0130. \u0130, x", *(f"BA{c}{stop} {c}{stop}" for c in ends for stop in ".,")]
    enc = token_ids.Encoder(PATH)
    for t, ids in zip(texts, enc.encode(texts, 1), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == plain(t, 1), t


def test_flat_files_round_trip(spark, plain, odd_docs, no_docs):
    folder, manifest = flat_ids.write_ids(odd_docs.repartition(3), PATH, 1)
    rows = flat_ids.read_ids(spark, folder).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, crc(plain(r.text, 1))) for r in odd_docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 2 * r.n_tokens
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert manifest.agg({"tokens": "sum"}).first()[0] == at
    folder, _ = flat_ids.write_ids(no_docs, PATH, 1)
    assert flat_ids.read_ids(spark, folder).count() == 0


@pytest.mark.parametrize("window", [4096, 64, 1])
def test_packing_covers_every_id_once(spark, plain, odd_docs, window):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("length(text) < 4000 or text is null")
    texts = {r.doc_id: plain(r.text, 2) for r in docs.collect()}
    pieces = packing.pack(docs.repartition(3), PATH, window=window).collect()
    seen, places = {i: {} for i in texts}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert ids == texts[p.doc_id][p.start : p.start + p.length] and p.ids_crc32 == crc(ids) and p.doc_tokens == len(texts[p.doc_id])
        assert p.cut_before == (p.start > 0) and p.cut_after == (p.start + p.length < p.doc_tokens)
        seen[p.doc_id][p.start] = p.length
        places[(p.sequence_id, p.offset)] = p.length
    for i, parts in seen.items():
        at = 0
        for s in sorted(parts):
            assert s == at
            at += parts[s]
        assert at == len(texts[i])
    total, at = sum(map(len, texts.values())), 0
    for (q, o), n in sorted(places.items()):
        assert q * window + o == at and o + n <= window
        at += n
    assert at == total


def test_packing_odd_rows(odd_docs, no_docs):
    assert packing.pack(odd_docs, PATH).where("start = 0").count() == odd_docs.count()
    assert packing.pack(no_docs, PATH).count() == 0


def test_texts_beyond_a_mebibyte(spark, plain):
    text = "Long words, don't end. " * 60_000
    assert len(text) > 1 << 20
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    want = plain(text, 1)
    folder, _ = flat_ids.write_ids(docs, PATH, 1)
    rows = {r.doc_id: r for r in flat_ids.read_ids(spark, folder, with_ids=False).collect()}
    assert (rows[1].n_tokens, rows[1].ids_crc32, rows[2].start) == (len(want), crc(want), len(want))
    pieces = sorted((p for p in packing.pack(docs, PATH, end_id=1).collect() if p.doc_id == 1), key=lambda p: p.start)
    assert sum((np.frombuffer(p.ids, "<u2").tolist() for p in pieces), []) == want
