import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import layout as L
from foliant.operators import tables as G
from foliant.options import Options
from foliant.plans import feeds
from foliant.plans.queries import ORACLE_SQL, QUERIES
from foliant.plans.render import list_lines


def over(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_text(spark):
    assert over(spark, T.normalize_unicode, ["oﬃce­​", "a b\tc", "é “q”", None]) == ["office", "a b c", "é\n“q”", None]
    assert over(spark, lambda v: T.join_hyphenated(v, F.lit(" tainous x")), ["moun- ", "x-", "moun", "moun-"]) == ["mountainous x", None, None, "mountainous x"]
    assert over(spark, T.escape_markdown, ["# a\n---\nb `c`", "12. x", "  + y", "*em*"]) == ["\\# a\n\\---\nb \\`c\\`", "\\12. x", "  \\+ y", "*em*"]
    assert over(spark, T.escape_cell, [" a|b\n c\\ "]) == ["a\\|b<br>c\\\\"]
    assert over(spark, T.looks_like_page_number, ["12", "- 3 -", "Page 3 of 40", "xiv", "A-3", "12 monkeys", "", "[ 4 ]"]) == [True] * 5 + [False, False, True]
    assert over(spark, T.repeat_signature, ["Page 3 of 40", "17", " — Annual  Report 2024 — "]) == ["page # of", "", "annual report"]
    marks = over(spark, T.list_marker, ["• one", "3) two words", "J. Smith", "A. long enough to be text here", "- ", "plain", " x"])
    assert [m and (m.marker, m.rest, m.ordered) for m in marks] == [("•", "one", False), ("3", "two words", True), None, ("A", "long enough to be text here", True), None, None, ("", "x", False)]
    assert over(spark, T.number_depth, ["3.2.1 Scope", "1. Intro", "Scope", "2024 was"]) == [3, 1, None, None]
    caps = over(spark, T.caption_label, ["Table 3.1: Revenue", "Fig. 2 - A map", "Table 4", "Chapter 2. x"])
    assert [c and (c.kind, c.label) for c in caps] == [("table", "Table 3.1"), ("figure", "Fig 2"), None, None]
    assert over(spark, T.is_numeric_cell, ["2,381", "7%", "$-3.5", "1e5", "1d", "", "n/a", "1_000", ".5"]) == [True, True, True, True, False, False, False, True, True]
    assert over(spark, T.superscript_digits, ["x²"]) == ["x2"]


def test_grids(spark):
    df = spark.createDataFrame([([["", " "], ["a", "", "1"], ["b"], [""]], [0.9, 0.1])], "rows array<array<string>>, bold array<double>")
    r = df.select(G.trimmed(F.col("rows")).alias("t"), G.looks_like_header(F.col("rows"), F.col("bold")).alias("h"), G.plausible(F.col("rows")).alias("p")).first()
    assert [list(x) for x in r.t] == [["a", "1"], ["b", ""]] and r.h and not r.p
    empty = spark.createDataFrame([([],), ([["", ""]],)], "rows array<array<string>>").select(G.trimmed(F.col("rows")).alias("t")).collect()
    assert [list(map(list, x.t)) for x in empty] == [[], []]


def test_lists_render_with_counters(spark):
    items = [("a", 0, True), ("b", 1, True), ("c", 1, True), ("d", 0, True), ("e", 1, True), ("f", 0, False)]
    df = spark.createDataFrame([([items],)], "x array<array<struct<text:string,level:int,ordered:boolean>>>").select(F.explode("x").alias("items"))
    assert df.select(list_lines(F.col("items"), Options()).alias("s")).first().s == "1. a\n  1. b\n  2. c\n2. d\n  1. e\n- f"


def test_headings_and_furniture(spark):
    rows = []
    for p in range(1, 5):
        rows += [("d", p, 1, "Annual Report", 40.0, 8.0, False), ("d", p, 2, f"{p}. Section {p}", 120.0, 15.0, True), ("d", p, 3, "body text that is long enough to vote for its size", 150.0, 10.5, False), ("d", p, 4, f"Sub {p}", 200.0, 12.0, True), ("d", p, 5, str(p), 760.0, 9.0, False)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, seq int, text string, top double, size double, bold boolean").withColumn("bottom", F.col("top") + 9).withColumn("height", F.lit(792.0)).withColumn("x0", F.lit(72.0))
    assert [tuple(r) for r in L.repeated_lines(lines, Options()).collect()] == [("d", "header", "annual report", 4)]
    assert {(r.page, r.seq) for r in L.page_numbers(lines, Options()).collect()} == {(p, 5) for p in range(1, 5)}
    assert L.body_sizes(lines).first().body == 10.5
    assert {(r.seq, r.level) for r in L.heading_model(lines, L.body_sizes(lines), Options()).collect()} == {(2, 1), (4, 2)}


def test_options():
    assert Options().with_(table_mode="csv").table_mode == "csv"
    for bad in ({"table_mode": "x"}, {"max_heading_level": 7}, {"header_band": 0.5}, {"pages": (0, 1)}, {"min_heading_ratio": 0.9}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "part", "nation", "region", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet')")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, where)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        one, two = (sorted(map(repr, rows)) for rows in ([tuple(r[c] for c in columns) for r in got.collect()], [tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()]))
        assert one == two, name


def test_headings_of_the_query_below_body_size(spark, tmp_path):
    """A bold numbered line in small print: no heading to the SQL, one to the operator."""
    duckdb = pytest.importorskip("duckdb")
    long = "words that set the size of the body " * 9
    spark.createDataFrame([(114, "\n".join(["x", long, "y", "z", "Z", "Small print."])), (6, f"x\nA Title\n{long}")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["heading_levels"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(ORACLE_SQL["heading_levels"]).fetchall()) and got and all(r[0] != 114 for r in got)
    lines = feeds.layout(spark, str(tmp_path)).where("doc_id = 114")
    assert [r.seq for r in L.heading_model(lines, L.body_sizes(lines), Options()).collect()] == [5]
