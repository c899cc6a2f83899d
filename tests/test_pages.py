"""Titles and links of odd pages."""

from __future__ import annotations

from quarrystone.plans import ORACLE_SQL, QUERIES

PAGES = [
    None,
    "",
    "no title <a href='/x'>x</a><a href=>y<a href=<a href=<A HREF=z><a  href=w>",
    "<title>cut off entities &amp;&amp</title>",
    "<title>&amp;lt; &lt;b&gt; &quot;q&quot; &copy; &#38; &apos;</title>",
    "<title> a\n\t b   c\x0bd\x1ce f  </title><title>second</title>",
    "<title>　 </title>",
    "<TITLE>upper</TITLE><title lang='en'>with an attribute</title><title>then one</title>",
    "<title>never closed <a href='/y'>",
    "<title></title><!-- <title>comment</title> --><script>'<a href='</script>",
    "<title><b>bold</b>\r\n\\1 $1 \U0001f600</title>" + "<a href=" * 300,
    "<title>" + "long &lt; " * 20_000 + "</title>",
]


def test_titles_of_odd_pages_equal_sql(spark, oracle, tmp_path):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql/pages.parquet").symlink_to(next((tmp_path / "pages.parquet").glob("part-*")))
    got = QUERIES["page_titles"](spark, str(tmp_path)).select("page_id", "title", "links").collect()
    assert sorted(map(tuple, got)) == sorted(oracle(ORACLE_SQL["page_titles"], str(tmp_path / "sql"))[1])
    assert sorted(map(tuple, got))[3] == (3, "cut off entities &&amp", 0)
