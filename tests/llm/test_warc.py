from conftest import sha

from scoreline.llm import warc


def answers(pages):
    first = {}
    for i, _, h in pages:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = first.get(raw, i) != i
        out.append((i, len(raw), sha(raw), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out)


def test_round_trip(spark):
    long, longer = "x" * 100, "é\r\n\r\nWARC/1.1\r\n" * 30
    pages = [(i, f"http://h/{i}", [long, "x" * 99, longer, None, "", f"<p>{i}</p>" * 40][i % 6]) for i in range(60)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, shard int").repartition(4)
    folder, index = warc.write_archives(warc.decide(df), frame_bytes=2000)
    records = warc.read_records(spark, folder)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(records).collect())
    assert got == answers(pages)
    assert index.agg({"frame": "max"}).first()[0] > 0
    picked = warc.read_records(spark, folder, index.where("page_id = 2")).collect()
    assert [(r.page_id, r.url, bytes(r.payload).decode()) for r in picked] == [(2, "http://h/2", longer)]


def test_frames_are_plain_zstandard(spark):
    import pyarrow.fs as fs
    import zstandard

    df = spark.createDataFrame([(1, "u\r\nX: y", "a" * 500), (2, None, "b" * 500)], "page_id long, url string, html string").coalesce(1)
    folder, index = warc.write_archives(warc.decide(df), frame_bytes=100)
    store, root = fs.FileSystem.from_uri(folder)
    shard = index.select("shard").first()[0]
    raw = store.open_input_file(f"{root}/{shard}").read()
    text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and b"u%0D%0AX: y" in text
    table = warc.read_seek_table(store.open_input_file(f"{root}/{shard}"))
    assert len(table) == 2 and table[:, 2].sum() == len(text)


def test_odd_rows(spark):
    cols = "page_id long, url string, html string"
    rows = [(1, "u", "z" * 200), (1, "u", "z" * 200), (None, "u", "z" * 200), (2, None, "z" * 200), (3, "u", None)]
    folder, _ = warc.write_archives(warc.decide(spark.createDataFrame(rows, cols)))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(warc.read_records(spark, folder)).collect()]
    assert sorted(got, key=str) == sorted([(1, "response", None, 200), (1, "response", None, 200), (None, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "response", None, 0)], key=str)
    folder, _ = warc.write_archives(warc.decide(spark.createDataFrame([], cols)))
    assert warc.resolve(warc.read_records(spark, folder)).count() == 0


def test_odd_characters_of_urls():
    from urllib.parse import unquote

    url = "http://a.example/\u2028x\u00a0y\r\n\tz/\u00fc"
    back = warc.parse(warc.record(1, url, "00", None, b"p", "2024-01-01T00:00:00Z"))
    assert "\n" not in back["url"] and "%E2%80%A8" in back["url"] and unquote(back["url"]) == url
    assert back["payload"] == b"p" and back["page_id"] == 1
