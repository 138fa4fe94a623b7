from pyspark.sql import functions as F

from tessera.operators import viewing
from tessera.sources import spans


def test_join_lines(spark):
    got = spark.createDataFrame([(["repre-", "sentation", "U-", "Net", " ", "a b"],)], ["x"]).select(spans.join_lines(F.col("x"))).first()[0]
    assert got == "representation U- Net a b"


SPAN = "doc_id long, page int, block int, line int, ord int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"


def test_blocks(spark):
    rows = [(1, 0, 0, 0, 0, "Bold ", 12.1, True, 0.0, 0.0, 5.0, 5.0), (1, 0, 0, 0, 1, "x", 10.0, False, 5.0, 0.0, 6.0, 5.0), (1, 0, 0, 1, 0, " ", 9.0, False, 0.0, 9.0, 9.0, 9.0)]
    b = spans.blocks(spark.createDataFrame(rows, SPAN)).first()
    assert (b["text"], b["size"], b["bold"], b["x1"], b["y1"], b["n_lines"]) == ("Bold x", 12.0, True, 9.0, 9.0, 2)


def test_blank_spans_and_turned_lines(spark):
    """Blank spans part words, turned and backward lines say nothing, sizes go to even halves, blocks without text go."""
    span = lambda block, line, n, text, size=10.0, bold=False, dx=1.0, dy=0.0: (1, 0, block, line, n, text, size, bold, 0.0, 0.0, 1.0 + n, 1.0, dx, dy)
    rows = [
        span(0, 0, 0, "Deep"), span(0, 0, 1, " "), span(0, 0, 2, "learning"), span(0, 1, 0, "\u00a0 of\u2009repre-"), span(0, 2, 0, "sentation "),
        span(0, 3, 0, "Margin stamp", 20.0, True, 0.0, -1.0), span(0, 4, 0, "sdrawkcab", 20.0, True, -1.0, 0.0),
        span(1, 0, 0, " \u00a0"), span(1, 1, 0, "turned", 9.0, False, 0.0, 1.0),
        span(2, 0, 0, "   abc   ", 10.25, True), span(2, 0, 1, "defg", 10.75), span(2, 0, 2, "", 30.0),
    ]
    got = {r["ord"]: r for r in spans.blocks(spark.createDataFrame(rows, SPAN + ", dx double, dy double")).collect()}
    assert set(got) == {0, 2}
    assert (got[0]["text"], got[0]["size"], got[0]["bold"], got[0]["first_span"], got[0]["n_lines"], got[0]["x1"]) == ("Deep learning of representation", 10.0, False, "Deep", 3, 3.0)
    assert (got[2]["text"], got[2]["size"], got[2]["bold"], got[2]["first_bold"], got[2]["first_span"]) == ("abc defg", 11.0, False, True, "abc")


def test_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10 + b"%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"no")
    good, bad = spans.read_pdfs(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1) and len(good.first()["doc_id"]) == 16


def test_cached_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"doc_id": 1, "schema_version": 1, "build_key": "k"}\n{"doc_id": 2, "schema_version": 1, "build_key": "old"}\nbroken\n')
    assert [r["doc_id"] for r in spans.read_documents(spark, str(tmp_path), "doc_id long", 1, "k").collect()] == [1]


def test_viewing(spark):
    words = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 20.0, 0.0, 30.0, 10.0)], "doc_id long, page int, word_id int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(7, 1, 0, 17.0, 5.0)], "point_id int, doc_id long, page int, x double, y double")
    assert viewing.nearest_word(words, points).first()["word_id"] == 2
    page = "One two  three four five six seven eight nine."
    got = spark.createDataFrame([(page, "one two three four five other words follow here"), (page, "none of it")], ["p", "s"]).select(viewing.probe(F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["one two three four five", None]
    assert spark.range(1).select(viewing.linked(F.lit("x [S1]"))).first()[0] == 'x <a href="#S1">[S1]</a>'
    tops = spark.createDataFrame([(1, 0, 0.0), (1, 1, 800.0)], "doc_id long, page int, top double")
    assert viewing.page_at(tops, spark.createDataFrame([(1, 1, 900.0)], "probe_id int, doc_id long, y double")).first()["page"] == 1
