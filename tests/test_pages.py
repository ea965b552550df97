"""Blocks of HTML pages against an extraction by patterns."""

import html
import re

from evidence_spark.plans.retrieval import html_page_blocks

SF = "/root/testdata/sf0.01"


def plain(markup):
    return re.sub(r"\s+", "", html.unescape(re.sub(r"<[^>]+>", "", markup)))


def test_blocks_of_every_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in html_page_blocks(spark, SF).orderBy("page_id", "order_index").collect():
        got.setdefault(r["page_id"], []).append(r)
    paragraphs = 0
    for page, text in pages.items():
        rows = got.get(page, [])
        assert [r["order_index"] for r in rows] == list(range(len(rows)))
        body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", text or "")
        title = re.search(r"(?s)<title>(.*?)</title>", body)
        assert not title or {r["title"] and plain(r["title"]) for r in rows} <= {plain(title[1]), None}
        headings = [(int(n), plain(t)) for n, t in re.findall(r"(?s)<h([1-6])\b[^>]*>(.*?)</h\1>", body) if plain(t)]
        assert [(r["level"], plain(r["text"])) for r in rows if r["block_type"] == "heading"] == headings
        texts = iter(plain(r["text"]) for r in rows)
        for p in re.findall(r"(?s)<p\b[^>]*>(.*?)(?=</?(?:p|li|h[1-6])\b)", body):  # an open paragraph ends where the next begins
            if plain(p):
                paragraphs += 1
                assert plain(p) in texts  # in order
        assert not any("track(" in (r["text"] or "") for r in rows)
        last = None
        for r in rows:
            last = r["text"] if r["block_type"] == "heading" else last
            assert r["section_title"] == last
    assert paragraphs > len(pages)
