from __future__ import annotations

import duckdb
from oracle import difference

from quillgraph.operators import pages
from quillgraph.plans import catalog

ODD = ["cut &amp;&amp", "cut &am", "cut &quot", "&copy; &#38; &#39 &lt;b&gt; &amp;amp; &amp;lt;", "a <b> b &amp </b> c", " \n&quot;x&#39;\t", "\U000f0000 & &amp", ""]


def test_html_fields_against_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    rows = [(n, "", f'<html><body><h1>{t}</h1><div class="ad">{t}</div></body></html>') for n, t in enumerate(ODD)]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [*rows, (100, "", None), (101, "", "")])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert difference(catalog.QUERIES["html_fields"](spark, str(tmp_path)), str(tmp_path), catalog.ORACLES["html_fields"]) == ""


def test_decoded_references():
    page = f'<h1>&amp &copy; b</h1><script>a &copy; &amp; c</script><div class="{pages.Fields.main}"><a class="lemma_inlink" href="/item/x&amp;&lt;">t</a></div>'
    html, only = pages.Fields(title=""), pages.Fields(title="", decoded=("&amp;",))
    assert [pages.page_fields(page, f)["title"] for f in (html, only)] == ["& © b", "&amp &copy; b"]
    assert [pages.inner_links(page, f)[0]["url"] for f in (html, only)] == [html.base + "/item/x&<", html.base + "/item/x&&lt;"]
    assert [e.text() for e in pages._Tree(page, only.decoded).root.having("", "script")] == ["a &copy; &amp; c"]
