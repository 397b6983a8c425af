import random

from conftest import prose, sha, words

from scoreline.llm import sketches, substring_dedup


def brute(docs, window=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                stay[k : k + window] = [False] * window
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        out[i] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    return out


def passages(rng):
    shared = [prose(rng, n, 10**6) for n in (49, 50, 51, 75, 130, 400)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += prose(rng, rng.randrange(0, 60), 50 if i % 7 == 0 else 10**6)
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            w += p[a:] if rng.random() < 0.5 else p
        docs.append((i, ("\n" if i % 2 else " ").join(w)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "tiny"), (103, "tiny"), (104, None), (105, ""), (106, " ".join(["same"] * 200)), (107, " ".join(["same"] * 120))]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    docs = passages(random.Random(1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs)


def test_other_window(spark):
    docs = passages(random.Random(2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string"), window=21).collect()}
    assert got == brute(docs, 21)


def test_texts_keep_columns(spark):
    docs = [(i, t, "s", "whole") for i, t in passages(random.Random(3))]
    df = spark.createDataFrame(docs, "doc_id long, text string, places string, whole string")
    out = substring_dedup.removed(df, texts=True)
    assert out.columns == df.columns
    want, old = brute([d[:2] for d in docs]), {d[0]: d[1] for d in docs}
    for r in out.collect():
        n = want[r.doc_id]
        assert (r.text == old[r.doc_id]) if n[1] == 0 else (sha(r.text.encode()) == n[2])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = substring_dedup.removed(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.n_removed == 0 for r in rows)
    assert sorted(r.n_words for r in rows) == sorted(len(words(r.text)) for r in odd_docs.collect())
    assert substring_dedup.removed(no_docs).count() == 0


def test_hot_hashes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 50)
    docs = passages(random.Random(4)) + [(200 + i, " ".join(prose(random.Random(9), 70, 10**6))) for i in range(30)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_filter_lets_the_same_share_through_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(sketches, "LEAST_BITS", 64)
    shares = []
    for n in (10, 10_000):  # a thousand times the words
        df = spark.range(n).selectExpr("id AS text_key", "array_join(transform(sequence(1, 300), i -> concat('w', id * 1000 + i)), ' ') AS text")
        shares.append(substring_dedup.probes_sent(df, 25, b"k" * 16).count() / (300 * n))
    # each text's own 12 blocks pass the filter of their index
    assert all(0.04 <= s <= 0.08 for s in shares)


def test_long_texts_and_long_words(spark):
    rng = random.Random(6)
    passage = prose(rng, 60, 10**6)
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, " ".join(prose(rng, 200_000, 10**6) + passage)), (2, " ".join(passage + prose(rng, 10, 10**6))), (3, " ".join([word] * 60)), (4, " ".join([twin] * 60)), (5, " ".join([twin] * 55))]
    assert len(docs[0][1]) > 1 << 20
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


#: Words that shared a hash when words were hashed without a key.
TWINS = ("hfgjt1yxdapaaaaa", "0k0bu3r18u29eye1")


def test_words_built_to_collide_stay_apart(spark):
    docs = [(1, " ".join([TWINS[0]] * 60)), (2, " ".join([TWINS[1]] * 60)), (3, " ".join([TWINS[0]] * 55))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[2][1] == 0 and got[3][1] == 55


def test_texts_that_share_a_key_are_judged_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    digest = substring_dedup.text_digest
    monkeypatch.setattr(substring_dedup, "text_digest", lambda text, key: (F.pmod(digest(text, key)[0], F.lit(3)), digest(text, key)[1]))
    rng = random.Random(5)
    shared = prose(rng, 60, 10**6)
    # equal keys only within texts that share nothing else, so anchors are seen
    docs = [(i, " ".join(prose(rng, 80, 10**6))) for i in range(12)] + [(20, " ".join(["x"] * 70)), (21, " ".join(["x"] * 70))] + [(30 + i, " ".join([*shared, f"e{i}"])) for i in range(9)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("doc_id").count().withColumnRenamed("count", "n_removed").collect()}
    assert not set(got) & set(range(12)) and 21 in got and 20 not in got
