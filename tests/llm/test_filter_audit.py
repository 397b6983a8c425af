import random
import re
from itertools import permutations

import pytest
from conftest import ODD, words

from scoreline.llm import filter_audit


def brute(docs, labels):
    """The whole report, order by order and document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    lowest, rows, out = {}, [], {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and lowest[t] < i}
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = (f, len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))
    total = {}
    for (part, _, _), v in out.items():
        total[part, v[0]] = total.get((part, v[0]), 0) + v[2]
    return {k: (*v, total[k[0], v[0]]) for k, v in out.items()}


def report(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_intervals_are_the_steps_of_every_order():
    for k in (1, 2, 3, 5):
        found = {}
        for mask, step, f, first, end in filter_audit.intervals(k):
            for r in range(first, end):
                assert (mask, r) not in found
                found[mask, r] = (step, f)
        for r, order in enumerate(permutations(range(k))):
            for mask in range(1, 1 << k):
                step = next(s for s, f in enumerate(order) if mask >> f & 1)
                assert found.pop((mask, r)) == (step + 1, order[step])
        assert not found
    assert len(filter_audit.intervals(5)) <= 840


def docs_of(seed, n=60):
    rng = random.Random(seed)
    texts = ["", None, "a b c", "SHOUT " * 60, "say # it " * 30, " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i}%" for i in range(55)), "same same " * 40]
    return [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_brute_force(spark, seed):
    docs = docs_of(seed)
    labels = [(i, random.Random(i).choice([0, 1, None]), random.Random(i + 1).choice([0, 1])) for i in range(15)] + [(3, 1, 0), (None, 1, 1)]
    df, of = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert report(filter_audit.audit(df, of)) == brute(docs, labels)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert report(filter_audit.audit(odd_docs, None)) == brute(docs, [])
    assert len(ODD) < len(docs)
    assert filter_audit.audit(no_docs, None).count() == 0


def test_copies_and_very_long_texts(spark):
    long = "word and Word " * 100_000  # over 1 MiB
    docs = [(i, "one text", "s") for i in range(500)] + [(900, long, "s"), (901, long, "t")]
    assert report(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), None)) == brute(docs, [])
