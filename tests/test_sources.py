"""Sources and streaming on small inputs."""

from pagemark.sources import pages as sources
from pagemark.streaming.ingest import follow


def test_text_files_and_sidecars(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x" * 3001)
    (tmp_path / "b.txt").write_bytes("Grüße".encode("cp1252"))
    (tmp_path / "c.md").write_text("no")
    (tmp_path / ".dscr").write_text("; note\nTopic=all\nOwner=top\n")
    (tmp_path / "in" / "a.txt.dscr").write_text("Owner=near\nOwner=later\n")
    rows = {(r.doc, r.page_no): r.text for r in sources.from_text_files(spark, "s", str(tmp_path), "*.txt").collect()}
    assert rows["in/a.txt", 1] == "x" * 3000 and rows["in/a.txt", 2] == "x"
    assert rows["b.txt", 1] == "Grüße" and not any(d == "c.md" for d, _ in rows)
    assert "Owner=near\n" in rows["in/a.txt", 0]


def test_html(spark):
    html = '<html><head><title>A=b</title><style>x{}</style></head><body>One<script>no()</script> <img src="i.png" alt="cat"> two &amp; <a href="/X#y">three</a></body></html>'
    rows = {r.page_no: r.text for r in sources.from_html(spark.createDataFrame([("u", html), ("e", "<p></p>")], "url string, html string"), "web", "url", "html").collect()}
    assert rows[1] == "A=b One cat two & three" and "Title=A b\n" in rows[0]


def test_rows_skip_nulls_and_keep_lines_apart(spark):
    df = spark.createDataFrame([(1, "a=b\nc", None)], "id int, tag string, other string")
    (row,) = sources.from_rows(df, "t", "id", None, ["tag", "other"]).collect()
    assert row.text == "Name=1\nSource=t\ntag=a b c\n"


def test_xml_manifest(spark, tmp_path):
    p = tmp_path / "m.xml"
    p.write_text("<root><basepath>/base/</basepath><document><title>t</title><file>a.txt</file></document><document><title>u</title></document><document><title>w</title><file>http://h/x</file></document></root>")
    assert sorted(r.file for r in sources.from_xml(spark, "x", str(p)).collect()) == ["/base/a.txt", "http://h/x"]


def test_streamed_pages_are_indexed_once(spark, tmp_path):
    pages = sources.from_rows(spark.createDataFrame([("n", "old dog")], "name string, body string"), "s", "name", "body", [])
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), stems=False).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("kind = 'form' AND page_no = 1")
    assert sorted(r.term for r in got.collect()) == ["dog", "old"]


def test_entry_registers_sql_only_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
