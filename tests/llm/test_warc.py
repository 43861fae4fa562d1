import base64
import hashlib
import random
import uuid

from textkin.llm import warc
from textkin.session import shared_dir


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        lead = first.get(h or "")
        again = lead is not None and i != lead
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", lead if again else None, warc.url_key(u)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    warc.write_archives(pages, at, **kw)
    return warc.read_archives(spark, at)


ROWS = [(3, "http://www.a.example/x#top", "<p>one</p>"), (1, "https://a.example/x", "<p>one</p>"), (2, "http://A.example:80/x", "two\r\n\r\nWARC/1.1\r\n\r\n"),
        (4, None, None), (5, "", ""), (None, "http://b.example", "two\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://b.example/a\r\nX-Evil: 1", "ünï"), (6, "http://b.example/?q", "ünï"),
        (None, "http://c.example", "only null ids"), (7, "http://user@sub.b.example/p", "long " * 100_000)]


def test_round_trip(spark):
    got = run(spark, ROWS).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key) for r in got), key=str) == sorted(
        [x if "X-Evil" not in str(x) else (*x[:5], warc.url_key("http://b.example/a%0D%0AX-Evil: 1")) for x in brute(ROWS)], key=str)


def test_small_payloads_may_all_be_responses(spark):
    got = run(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=4).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_rows(spark):
    held = run(spark, [])
    assert held.collect() == [] and warc.merge_index(held).collect() == []


def test_index_is_in_global_order(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(3)}.example/{'hot' if i % 3 else rng.randrange(20)}", f"x{i}") for i in range(300)]
    captures = run(spark, rows, archive_bytes=20_000)
    assert captures.select("run").distinct().count() > 3
    got = sorted(warc.merge_index(captures, range_rows=40).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, 301))
    keys = [(r.url_key, r.ts, r.page_id) for r in got]
    assert keys == sorted(keys)
    seen = {}
    for r in got:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))
