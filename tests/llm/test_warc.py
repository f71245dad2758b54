"""Archives written and read back, the index's order, and the loser tree against sorting."""

import base64
import hashlib
import random

from parallaxis.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string"


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((f"k{rng.randrange(9)}", "t", rng.randrange(99), f"a{r}", p, 1) for p in range(rng.randrange(0, 30))) for r in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc.order_key)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://m.example.com:8080") == "com,example,m:8080)/"
    assert warc.url_key("") == ")/"


def test_round_trip_and_revisits(spark):
    bodies = ["<p>one</p>", "<p>two é</p>", "", None, "WARC/1.1\r\n\r\nnot a record", "x" * 300_000]
    rows = [(i, f"http://h{i % 3}.example.com/{i}", bodies[i % len(bodies)], "clash") for i in range(40)] + [(100, None, "<p>one</p>", "c"), (None, "u", "<p>alone</p>", "c")]
    runs = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4))
    index = warc.merge(runs)
    entries = sorted(index.collect(), key=lambda r: (r["range"], r["place"]))
    keys = [warc.order_key(tuple(r)[:6]) for r in entries]
    assert keys == sorted(keys) and len(keys) == len(rows)
    got = {r["page_id"]: r for r in warc.read(index).collect()}
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first.setdefault(html or "", i)
    for i, url, html, _ in rows:
        body, r = (html or "").encode(), got[i]
        to = first.get(html or "", i)
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("response" if to == i else "revisit") and r["refers_to"] == (None if to == i else to)
        assert r["url"] == (url or "") and (to != i or bytes(r["payload"]) == body)


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], SCHEMA)
    out = {r["page_id"]: r["record_type"] for r in warc.read(warc.merge(warc.write(df, least_bytes=4))).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_null_id_refers_to_a_page_and_empty_table(spark):
    df = spark.createDataFrame([(9, "u", "same", ""), (None, "u", "same", ""), (9, "v", "same", "")], SCHEMA)
    out = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read(warc.merge(warc.write(df))).collect())
    assert out == [("9", "response", None), ("9", "response", None), ("None", "revisit", 9)]
    assert warc.read(warc.merge(warc.write(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_captures_of_a_key_are_numbered_over_all_ranges(spark):
    rows = [(i, "http://hot.example.com/", f"{i % 7}", f"2001-01-{1 + i * 13 % 28:02d}") for i in range(300)] + [(1000 + i, f"http://h{i}.example.com/", "x", "2001") for i in range(40)]
    index = warc.merge(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, ts string").repartition(5))).collect()
    assert len({r["range"] for r in index if r["urlkey"] == "com,example,hot)/"}) > 1, "the key goes over several ranges"
    want, seen = {}, {}
    for key, ts, page in sorted((warc.url_key(u), ts, i) for i, u, _, ts in rows):
        seen[key] = seen.get(key, 0) + 1
        want[page] = seen[key]
    assert {r["page_id"]: r["capture"] for r in index} == want
