import random

from pyspark.sql import functions as F

from scoreline.llm import language_id as li

SYLLABLES = {"en": ["the", "ing", "and", "er", "wh", "th"], "de": ["sch", "ein", "ung", "ver", "ich", "zu"], "fr": ["eau", "ou", "ent", "ai", "que", "é"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, text(rng, lang, rng.randrange(3, 40)), lang, lang, f"{lang}host{i % 2}.{'com' if lang == 'en' else lang}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, source string")


def fit(df, **k):
    return li.fit(df.select("doc_id", "text", F.col("lang").alias("label")), **k)


def test_held_out_accuracy(spark):
    df = corpus(spark)
    model = fit(df.where("doc_id < 150"))
    assert model[0] == ["de", "en", "fr"]
    rows = li.identify(df.where("doc_id >= 150").withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/x"))), model, url_col="url").collect()
    truth = {r.doc_id: r.truth for r in df.collect()}
    assert sum(r.language == truth[r.doc_id] for r in rows) / len(rows) > 0.97 and all(r.keep for r in rows)


def test_evidence_decides_what_the_text_leaves_open(spark):
    df = corpus(spark)
    model = fit(df)
    open_ = [(1000, "xx", "de", "dehost0.de"), (1001, "xx", "en", "enhost1.com"), (1002, "xx", None, "frhost0.fr"), (1003, "xx", None, None)]
    more = df.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(open_, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in li.identify(more, model).where("doc_id >= 1000").collect()}
    assert (got[1000].language, got[1001].language, got[1002].language) == ("de", "en", "fr")
    assert got[1003].confidence < got[1000].confidence


def test_host_prior_is_smoothed_by_its_domain(spark):
    df = corpus(spark).withColumn("url", F.concat(F.lit("http://a.big.com/"), F.col("doc_id").cast("string"))).where("lang = 'fr' or doc_id < 6")
    new = spark.createDataFrame([(5000, "xx", None, "http://new.big.com/")], "doc_id long, text string, lang string, url string")
    got = li.identify(df.select("doc_id", "text", "lang", "url").unionByName(new), fit(corpus(spark)), url_col="url", host_col=None).where("doc_id = 5000").first()
    assert got.language == "fr"


def test_sample_bound(spark):
    df = corpus(spark)
    few = fit(df, sample=5)
    assert few[0] == ["de", "en", "fr"] and few[1].shape == (3, li.CELLS)


def test_odd_rows(spark, odd_docs, no_docs):
    model = fit(corpus(spark))
    docs = odd_docs.withColumnRenamed("source", "s").withColumn("source", F.col("s"))
    rows = li.identify(docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r.keep for r in rows if r.doc_id in (0, 1, 2))
    assert li.identify(no_docs, model).count() == 0
    none = fit(no_docs)
    assert none[0] == [] and all(not r.keep and r.language is None for r in li.identify(docs, none).collect())


def test_visible_text_and_declaration_of_markup():
    page = "<!-- <html lang='xx'> --><HTML class=a xml:lang=\"de-AT\"><script>var t='</p>';</script><style>p{}</style><p>Stra&szlig;e 1 < 2</p><script>open"
    assert [" ".join(x.split()) for x in li.visible(page)] == ["Straße 1 < 2", "de"]
    assert li.visible(None) == (None, None) and li.visible("<p lang='fr'>a</p>")[1] is None


def test_query_covers_documents_and_pages_with_their_own_evidence(spark):
    from scoreline.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, pages = (queries.table(spark, sf, t) for t in ("documents", "pages"))
    rows = queries.op9_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows if r.page_id is None) == sorted(r.doc_id for r in docs.collect())
    declared = {r.page_id: li.visible(r.html)[1] for r in pages.collect()}
    assert {r.page_id: r.declared for r in rows if r.doc_id is None} == declared and None not in declared.values()
    # the training label declares nothing
    assert all(r.declared is None for r in rows if r.page_id is None)


def test_suffix_decides_what_the_text_leaves_open(spark):
    df = corpus(spark).withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/x")))
    new = spark.createDataFrame([(5000, "xx", "http://other.fr/"), (5001, "xx", "http://other.de/")], "doc_id long, text string, url string")
    got = li.identify(df.select("doc_id", "text", "url").unionByName(new), fit(df), declared_col=None, url_col="url", host_col=None).where("doc_id >= 5000").collect()
    assert {r.doc_id: r.language for r in got} == {5000: "fr", 5001: "de"}


def test_host_without_url_is_counted_once(spark):
    df = corpus(spark, 3).select("doc_id", "text", F.lit("one").alias("source"))
    model = fit(corpus(spark))
    new = spark.createDataFrame([(9, "", "one"), (10, "", None)], "doc_id long, text string, source string")
    rows = li.identify(df.where("doc_id = 0").unionByName(new), model, declared_col=None, smooth=1.0, strength=20.0).where("doc_id >= 9").collect()
    got = {r.doc_id: r for r in rows}
    # one English text: all documents give 2/4, the host (1 + 20 * 2/4) / 21
    assert abs(got[10].confidence - 0.5) < 1e-9 and abs(got[9].confidence - 11 / 21) < 1e-9


def test_text_of_no_known_language_is_rejected(spark):
    df = corpus(spark)
    new = spark.createDataFrame([(5000, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "en", "enhost1.com")], "doc_id long, text string, lang string, source string")
    rows = li.identify(df.select("doc_id", "text", "lang", "source").unionByName(new), fit(df)).collect()
    assert [r.doc_id for r in rows if not r.keep] == [5000]
