import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import ODD, sha

from scoreline.llm import sentence_pieces
from scoreline.llm.sentence_pieces import Model

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [*ODD, " a", "a ", "  two  spaces ", "\n\n x\n y \n", "▁ is ▁▁ here", "tab\tsep\r\n", "a\x00b", "<s> </s> <0x41> <unk>", "ﬁ ① ㍿ é ½ Å", "　wide　 ", "가각 가", "😀👨‍👩‍👧 ok", "x" * 3000]


def with_normalizer(name, **flags):
    """The public model with a library's own compiled character map in place of none."""
    from sentencepiece import SentencePieceNormalizer

    spec = SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    fields = dict(sentence_pieces._fields(spec))
    inner = dict(sentence_pieces._fields(fields[3]))
    assert len(inner[2]) > 1000

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = b"\x12" + varint(len(inner[2])) + inner[2] + b"".join(bytes([k << 3, flags.get(f, d)]) for k, f, d in ((3, "prefix", 1), (4, "collapse", 1), (5, "escape", 1)))
    with open(PATH, "rb") as f:
        return f.read() + b"\x1a" + varint(len(body)) + body


def check(model, library, text):
    ids, begins, ends = model.encode(text)
    assert ids.tolist() == library.encode(text or "", add_bos=True, add_eos=True), text
    assert model.decode(ids).decode() == library.decode(ids.tolist()), text
    want = [(p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces]
    assert list(zip(begins.tolist(), ends.tolist(), strict=True))[1:-1] == want, text


def noise(rng, n):
    return "".join(rng.choice("ab  cdE.\n▁é①ﬁ가́　​ñ😀\t") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80).collect()]


def test_public_model_equals_the_library(corpus, monkeypatch):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(1)
    for kept, block in ((10**6, 1 << 20), (10, 16)):
        monkeypatch.setattr(sentence_pieces, "KEPT_CUTS", kept)
        monkeypatch.setattr(sentence_pieces, "BLOCK", block)
        model = Model(PATH)
        assert model.cut is not None
        for text in [*TEXTS, *corpus, *(noise(rng, 60) for _ in range(200))]:
            check(model, library, text)


@pytest.mark.parametrize("flags", [{}, {"collapse": 0}, {"prefix": 0}, {"prefix": 0, "collapse": 0}])
@pytest.mark.parametrize("name", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_maps_equal_the_library(corpus, name, flags):
    proto, rng = with_normalizer(name, **flags), random.Random(2)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=proto), Model.of(proto)
    for text in [*TEXTS, *corpus[:20], *(noise(rng, 40) for _ in range(300))]:
        raw = (text or "").encode()
        normal, align = model.normalize(raw)
        assert normal.decode() == library.normalize(text or "") and len(align) == len(normal) + 1, text
        check(model, library, text)


def test_any_ids_decode_as_the_library(corpus):
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), Model(PATH), random.Random(3)
    for k in range(500):
        top = (300, 300, 32000)[k % 3]
        ids = [rng.randrange(top) for _ in range(rng.randrange(12))]
        assert model.decode(ids).decode() == library.decode(ids), ids


def test_rows_and_round_trip(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(library.decode(ids).encode()), len((r.text or "").encode())))
    got = sentence_pieces.digests(odd_docs.repartition(3), PATH)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(want, key=key)
    rows = sentence_pieces.encode(odd_docs, PATH)
    back = sentence_pieces.decode(rows, PATH).collect()
    assert sorted((r.doc_id or -1, sha(r.text.encode())) for r in back) == sorted((w[0] or -1, w[3]) for w in want)
    for r in rows.where("doc_id = 7").collect():
        raw = ODD[7].encode()
        assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
    for f in (sentence_pieces.digests, sentence_pieces.encode):
        assert f(no_docs, PATH).count() == 0


def test_very_long_text(spark):
    text = "long words don't end " * 60_000  # over 1 MiB
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    row = sentence_pieces.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert row.ids_sha256 == sha(np.array(ids, "<u4").tobytes()) and row.decoded_sha256 == sha(library.decode(ids).encode())
