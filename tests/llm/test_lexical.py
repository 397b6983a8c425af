import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scoreline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank) -> (doc, score), over rows."""
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, q in asked.items():
        scored = []
        for d, c, size in own:
            m = 25 + 75 * size * n // length
            s = sum(rep * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, rep in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        for r, (s, known, d) in enumerate(sorted(scored)[:k], 1):
            out[i, r] = (d if known else None, -s)
    return out


def found(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def frames(spark, docs, items, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed,terms_a_run,cells", [(0, 4096, 1 << 22), (1, 5, 300), (2, 1, 16), (3, 20, 4000)])
def test_search_equals_brute_force(spark, monkeypatch, seed, terms_a_run, cells):
    monkeypatch.setattr(lexical, "TERMS", terms_a_run)
    monkeypatch.setattr(lexical, "PASS_TERMS", max(12, terms_a_run))
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "ñ", "rare%d" % rng.randrange(30), "e", "f"])
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    docs = [(rng.choice([None, *range(90)]), text(40)) for _ in range(150)] + [(7, None), (8, ""), (9, " .,;")]
    docs += [docs[5]] * 3
    items = [(i, text(12)) for i in range(9)] + [(3, "a again rare1"), (None, "b rare2"), (20, None), (21, ""), (22, "absent")]
    d, i = frames(spark, docs, items)
    assert found(lexical.search(d, i)) == brute(docs, items)


def test_ties_and_one_hot_term(spark):
    docs = [(i, "same text here") for i in range(400)] + [(1000 + i, f"other words {i}") for i in range(50)]
    items = [(1, "text"), (2, "same same words"), (3, "7 text")]
    d, i = frames(spark, docs, items, 5)
    assert found(lexical.search(d, i)) == brute(docs, items)


def test_block_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    docs, width = 2000, 6
    cells = np.flatnonzero(rng.random(docs * width) < 0.5)
    term, doc = cells // docs, cells % docs
    impact = (1e6 / (1 + rng.exponential(30, len(cells)))).astype(np.int64)
    block, w = lexical.Block(width, docs, term, doc, impact), np.array([5, 4, 3, 2, 2, 1])
    whole = w @ block.impact.astype(np.int64)
    want = sorted(zip((-whole).tolist(), range(docs), strict=True))[:10]
    got, scores = block.best(np.arange(width), w, 0, 10)
    assert sorted(zip((-scores).tolist(), got.tolist(), strict=True))[:10] == want
    least = -want[4][0]
    got, scores = block.best(np.arange(width), w, least, 10)
    assert set(got.tolist()) == {d for s, d in want if -s >= least}


def test_odd_texts(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(i, t) for i, (_, t) in enumerate(docs)]
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "'x' as doc_id", "2 as score")
    assert found(lexical.search(odd_docs, i)) == brute(docs, items)
    assert lexical.search(no_docs, i).count() == 0
    assert lexical.search(odd_docs, i.where("false")).count() == 0


def test_very_long_text_is_read_in_pieces(spark, monkeypatch):
    long = "alpha beta gamma, é" * 80_000  # over 1 MiB
    raw = long.encode()
    want = Counter(t.encode() for t in terms(long))
    for piece in (7, 1000, 1 << 20):
        monkeypatch.setattr(lexical, "PIECE", piece)
        cut = raw if piece > 7 else raw[:5000]
        got = Counter()
        for part in lexical.terms_of(cut):
            got.update(part)
        assert got == (want if piece > 7 else Counter(t.encode() for t in terms(cut.decode(errors="surrogateescape").encode(errors="surrogateescape").decode())))
    docs, items = [(1, long), (2, "alpha"), (3, "éalpha")], [(1, "alpha éalpha"), (2, "beta")]
    d, i = frames(spark, docs, items)
    assert found(lexical.search(d, i)) == brute(docs, items)
