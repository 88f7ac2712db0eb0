"""JDBC copies, with the embedded database that Spark brings along, and scans of TEI files."""

from foliospark.sources.parsed import read_tei
from foliospark.sources.tables import copy_absent, read_table


def test_copy_absent(spark):
    one, two = "jdbc:derby:memory:one;create=true", "jdbc:derby:memory:two;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    put = lambda rows, url: spark.createDataFrame(rows, "id long, title string").write.jdbc(url, "papers", properties={"driver": driver})
    put([(i, f"new {i}") for i in range(1, 41)], one)
    put([(3, "old 3"), (40, "old 40"), (99, "old 99")], two)
    for _ in range(2):
        copy_absent(spark, one, two, "papers", ["id"], by="id", parts=4, driver=driver)
        got = {r["ID"]: r["TITLE"] for r in read_table(spark, two, "papers", driver=driver).toDF("ID", "TITLE").collect()}
        assert len(got) == 41 and got[3] == "old 3" and got[40] == "old 40" and got[99] == "old 99" and got[7] == "new 7"
    assert read_table(spark, one, "papers", by="id", parts=4, driver=driver).rdd.getNumPartitions() == 4
    put([], "jdbc:derby:memory:three;create=true")
    copy_absent(spark, "jdbc:derby:memory:three", two, "papers", ["id"], by="id", driver=driver)
    assert read_table(spark, two, "papers", driver=driver).count() == 41


TEI = """<?xml version="1.0"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc>
<profileDesc><abstract><div><p>About &amp; <hi>more</hi></p></div></abstract></profileDesc></teiHeader>
<text><body><div><head>Early</head></div><pb n="3"/><div><head>A</head><p>one <ref type="b">x &lt; y</ref> two</p><formula>e</formula></div><pb n="4"/>
<div><head>C</head><div><head>B</head><p>b</p><pb n="odd"/><div><head>B1</head><p>b1</p><div><head>B11</head><div><head>B111</head></div></div></div>
<div><head>Appendix</head><div><head>Lost</head></div></div><div><head>B2</head></div></div><pb n="6"/><figure><figDesc>fig</figDesc></figure></div>
<figure type="table"><figDesc>tab</figDesc><table><row><cell>a <b>x</b></cell></row><row><cell>1</cell></row></table></figure></body></text></TEI>"""


def test_tei(spark, tmp_path):
    """Pages by the breaks before, sections below sections, inner marks, a broken file."""
    (tmp_path / "a.xml").write_text(TEI)
    (tmp_path / "b.xml").write_text(TEI[:200])
    (row,) = read_tei(spark, str(tmp_path)).collect()
    assert (row.title, row.authors, row.abstract) == ("T", [], "About & more")
    assert [(s.title, s.page, s.content) for s in row.sections] == [("Early", 3, ""), ("A", 3, "one x < y two"), ("B", 4, "b")]
    assert [(s.title, s.page, s.content) for s in row.sections[2].subsections] == [("B1", 1, "b1"), ("B2", 1, "")]
    assert [(s.level, s.title) for s in row.sections[2].deeper] == [(2, "B11"), (3, "B111")]
    assert [tuple(t) for t in row.tables] == [("tab", 6, "| a x |\n| --- |\n| 1 |")]
    assert [tuple(f) for f in row.figures] == [("fig", 6, "C")]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "c.xml").write_text(TEI.replace("\n", " ") + "\n" + TEI.replace("\n", " "))
    assert read_tei(spark, str(tmp_path / "lines"), lines=True).collect() == [row, row]
