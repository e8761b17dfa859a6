import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from weftwork.llm import hamming, warc

PAGES = "page_id long, url string, html string, date string"


def pages():
    rng = random.Random(4)
    rows = [(k, f"https://www.H{k % 3}.example.com:8080/p/{rng.randrange(9)}?q={k % 4}#f", rng.choice(["<p>a</p>", "", "é\r\n\r\nWARC/1.1\r\n", f"own {k}"]), "x") for k in range(60)]
    return rows + [(60, None, None, None), (61, "not a url \r\nx", "own 3", None), (62, "http://[bad", "z" * 300_000, None), (63, "http://a:99999/", "p", None), (5, rows[5][1], rows[5][2], None), (None, "http://n.example/", "only null", None)]


def test_warc_round_trip(spark, tmp_path):
    rows = pages()
    index = warc.capture_index(spark.createDataFrame(rows, PAGES).repartition(4), str(tmp_path / "warc"))
    got = index.collect()
    first = {}
    for p, _, html, _ in rows:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    expected = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        lead = first.get(html or "")
        expected.append(str((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == lead else "revisit", None if p == lead else lead)))
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(expected)
    ordered = sorted(got, key=lambda r: (r["part"], r["position"]))
    keys = [(r["url_key"], r["date"], r["page_id"] is not None, r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    for r in got:  # each record can be had on its own by its place in the archive
        raw = (tmp_path / "warc" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        capture = warc.parsed(gzip.decompress(raw))
        assert (capture.page_id, capture.record_type) == (r["page_id"], r["record_type"])
    assert warc.capture_index(spark.createDataFrame([], PAGES), str(tmp_path / "none")).count() == 0


def test_ranges_and_runs(spark, tmp_path):
    """Many short runs over many ranges, with one hot host, come out in one order."""
    rows = [(k, "http://hot.example/x" if k % 3 else f"http://h{k}.example/", f"{k}", None) for k in range(200)]
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(5), folder)
    runs = warc.capture_runs(manifest, folder, run_rows=7)
    got = sorted(warc.merged(runs, range_rows=20).collect(), key=lambda r: (r["part"], r["position"]))
    assert [r["page_id"] for r in got] == [r["page_id"] for r in sorted(got, key=lambda r: (r["url_key"], r["date"], r["page_id"]))]
    assert len({r["part"] for r in got if r["url_key"].startswith("example,hot")}) > 1 and len(got) == 200


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted([("r", rng.choice("ab"), str(rng.randrange(5)), rng.choice([None, 1, 2])) for _ in range(rng.randrange(0, 9))], key=warc.order_of) for _ in range(k)]
    got = list(warc.LoserTree(runs))
    assert [warc.order_of(x) for x in got] == sorted(warc.order_of(x) for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_damage_is_seen():
    raw = warc.record(1, "http://a/", b"payload", 7, warc.payload_digest(b"payload"))
    assert warc.parsed(raw).payload == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parsed(raw[:-3])


def test_url_key():
    assert warc.url_key("https://www.Example.com:80/A?b#c") == "com,example:80)/a?b" and warc.url_key(None) == "" and warc.url_key("http://x.y") == "y,x)/"


def brute_top(rows, queries, k, bits):
    def code(v):
        return sum(1 << i for i in range(bits) if i < len(v) and v[i] is not None and v[i] > 0)

    known = {(i, code(v)) for i, v in rows if i is not None and v is not None}
    out = []
    for q, c in {x for x in known if x[0] in queries}:
        best = {}
        for i, d in known:
            if i != q:
                best[i] = min(best.get(i, 99), (c ^ d).bit_count())
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "k", "block"), [(300, 10, 64), (6, 10, 64), (120, 3, 5)])
def test_top_k_against_brute_force(spark, n, k, block):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + 0.8 * rng.normal(size=64)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # one very common vector
    rows += [(None, rows[1][1]), (n + 50, None), (n + 51, []), (n + 52, [1.0, None, -1.0]), rows[2]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    config = hamming.SearchConfig(k=k, block_rows=block)
    coded = hamming.coded(df, config)
    queries = {0, 3, n + 52, n + 51}
    got = hamming.top_k(coded, coded.where(coded["id"].isin(*queries)).distinct(), config).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, queries, k, 64)


def test_top_k_stops_early():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    index = hamming.MultiIndex(codes, [np.array([i]) for i in range(len(codes))], 64)
    for q in range(0, 50, 10):
        expected = sorted((int(d), i) for i, d in enumerate(np.bitwise_count(codes ^ codes[q])) if i != q)[:10]
        assert index.nearest(codes[q], q, 10) == expected


def test_top_k_empty(spark):
    config = hamming.SearchConfig()
    none = hamming.coded(spark.createDataFrame([], "vec_id long, embedding array<float>"), config)
    assert hamming.top_k(none, none, config).count() == 0
