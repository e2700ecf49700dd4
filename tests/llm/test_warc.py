"""Look-ups in archives: odd and repeated keys, keys over several blocks, and keys that aren't there."""

import pytest
from pyspark.sql import functions as F

warc = pytest.importorskip("helixspark.llm.warc")
SCHEMA = "page_id long, url string, html string, want string, n string, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def got(df):
    return sorted((r.page_id is None, r.page_id or 0, r.record_type, bytes(r.payload or b"")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    odd = [(1, "foo\tbar", "a"), (2, "foo !b", "b"), (3, "fop", "c"), (4, "foo\\tbar", "d"), (5, "x\ny", "e"), (6, None, "f"), (7, "", "g"), (8, "http://[bad", "h"), (9, "http://ä.example/\U00010000", "i"), (None, "no id", "j")]
    same = [(100 + i, "http://hot.example.com/", f"page {i}") for i in range(20)]  # one key over several blocks
    shared = [(200 + i % 3, f"http://s.example.com/{i % 2}", "p" * 120) for i in range(6)]  # repeated ids and urls, equal payloads
    return odd + same + shared


def test_three_pages_with_a_tab(spark, tmp_path):
    rows = [(1, "foo\tbar", "a"), (2, "foo !b", "b"), (3, "fop", "c")]
    archive = warc.write(table(spark, rows), f"file://{tmp_path}/w", block_lines=1)
    assert [r[1] for r in got(archive.lookup(table(spark, rows)))] == [1, 2, 3]


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_lookup(spark, tmp_path, rows, lines):
    archive = warc.write(table(spark, rows), f"file://{tmp_path}/w", block_lines=lines, index_rows=9)
    every = got(archive.records())
    assert len(every) == len(rows) and got(archive.lookup(table(spark, rows))) == every
    for url in ("foo\tbar", "foo\\tbar", "x\ny", "http://HOT.example.com:/", "http://s.example.com/1", "http://nowhere.example.com/", "zzz"):
        want = got(archive.records().where(F.col("url_key") == warc.url_key(url)))
        asked = table(spark, [(0, url, None)] * 2)
        assert got(archive.lookup(asked)) == want and len(want) == sum(warc.url_key(r[1]) == warc.url_key(url) for r in rows)
    assert len(got(archive.lookup(table(spark, [(0, None, None)])))) == 2  # null and empty urls have one key
    assert got(archive.lookup(table(spark, []))) == []


def test_lookup_without_blocks_and_its_plan(spark, tmp_path, rows):
    empty = warc.write(table(spark, []), f"file://{tmp_path}/e")
    assert got(empty.lookup(table(spark, rows))) == []
    archive = warc.write(table(spark, rows), f"file://{tmp_path}/w", block_lines=3)
    plan = archive.lookup(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BatchEvalPython" not in plan and "Cartesian" not in plan


def test_keys_are_told_apart():
    urls = ["a\tb", "a\\tb", "a\nb", "a\\nb", "a\\b", "a%09b"]
    assert len({warc.url_key(u) for u in urls}) == len(urls) and not any("\t" in warc.url_key(u) or "\n" in warc.url_key(u) for u in urls)
