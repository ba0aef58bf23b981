import gzip
import threading
import zipfile
from collections import Counter
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from kalibra.sources import fetch, readers, sinks, tables


def test_csv_with_mark_and_bad_numbers(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("﻿name,x\na,1.5\nb,bad\n".encode())
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    assert [tuple(r) for r in readers.delimited(spark, str(f), schema=schema).collect()] == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError):
        readers.delimited(spark, str(f), schema=T.StructType([T.StructField("nope", T.StringType())]))
    assert readers.optional(spark, None, schema).count() == 0


def test_blanks_gzipped(spark, tmp_path):
    f = tmp_path / "a.txt.gz"
    f.write_bytes(gzip.compress(b"p1  p2 score\nx y   900\n\ny z 10\n"))
    assert [tuple(r) for r in readers.by_suffix(spark, str(f)).collect()] == [("x", "y", "900"), ("y", "z", "10")]
    g = tmp_path / "b.txt"
    g.write_text('p1  p2\np1  p2\n"q  2\n')  # a row like the header is a row
    assert [tuple(r) for r in readers.by_suffix(spark, str(g)).collect()] == [("p1", "p2"), ('"q', "2")]


def test_workbook(spark, tmp_path):
    f = tmp_path / "b.xlsx"
    m, o = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{o}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>herb</t></si><si><t>n</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.by_suffix(spark, str(f), "One").collect()] == [(None, "5")]
    with pytest.raises(ValueError):
        readers.workbook(spark, str(f), ["Two"])


def test_series_matrix(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text('!Sample_title\t"Lesion 1"\t"Healthy 2"\n!Sample_geo_accession\t"G1"\t"G2"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1.5\tnull\n"p2"\t2\t3\n!series_matrix_table_end\n')
    got = {(r.probe, r["sample"]): r.value for r in readers.series_matrix(spark, str(f)).collect()}
    assert got == {("p1", "G1"): 1.5, ("p1", "G2"): None, ("p2", "G1"): 2.0, ("p2", "G2"): 3.0}
    assert {tuple(r) for r in readers.series_samples(spark, str(f), {"healthy": "CONTROL"}).collect()} == {("G1", "Lesion 1", "OTHER"), ("G2", "Healthy 2", "CONTROL")}


def test_sets_annotations_ontology(spark, tmp_path):
    (tmp_path / "g.gmt").write_text("S1\turl\tA\tB\nS2\t\tC\n")
    assert {tuple(r) for r in readers.gene_sets(spark, str(tmp_path / "g.gmt"), 2).collect()} == {("S1", "url", "A"), ("S1", "url", "B"), ("S2", "", "C")}
    line = lambda q, a: "\t".join(["DB", "1", "TP53", q, "GO:1", "r", "IEA", "", a, "n", "", "protein", "t", "d", "x"])
    (tmp_path / "a.gaf").write_text("!c\n" + line("involved_in", "P") + "\n" + line("NOT|involved_in", "P") + "\n" + line("", "F") + "\nshort\tline\n")
    assert [tuple(r) for r in readers.annotations(spark, str(tmp_path / "a.gaf")).collect()] == [("TP53", "GO:1")]
    (tmp_path / "o.obo").write_text("format: 1\n\n[Term]\nid: GO:1\nname: one\nnamespace: bp\nis_a: GO:2 ! two\nrelationship: part_of GO:3 ! three\n\n[Term]\nid: GO:4\nname: gone\nis_obsolete: true\nis_a: GO:2\n\n[Typedef]\nid: part_of\n")
    terms = readers.ontology(spark, str(tmp_path / "o.obo"))
    assert {(r.term, r.obsolete) for r in terms.collect()} == {("GO:1", False), ("GO:4", True)}
    assert {tuple(r) for r in readers.ontology_edges(terms).collect()} == {("GO:1", "GO:2"), ("GO:1", "GO:3")}
    (tmp_path / "k.txt").write_text("path:hsa1\thsa:10\n")
    assert [tuple(r) for r in readers.pathway_links(spark, str(tmp_path / "k.txt")).collect()] == [("hsa1", "10")]


def test_counts_and_annotation(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,s1,s2\ng1,1,2\n")
    assert {tuple(r) for r in readers.count_matrix(spark, str(tmp_path / "c.csv")).collect()} == {("g1", "s1", 1.0), ("g1", "s2", 2.0)}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.txt", "#c\nID\tS\nx\ty\n")
    assert [r.line for r in readers.platform_annotation(spark, str(tmp_path / "p.zip")).collect()] == ["ID\tS", "x\ty"]


def test_pages(spark):
    html = "<h1>A &amp; B</h1><table><tr><th>No</th></tr></table><table><tr><th>Gene</th><th>Class</th></tr><tr><td><b>TP53</b></td><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [tuple(r)[0:1] + (r.cells,) for r in tables.page_cells(pages, ["gene", "class"]).collect()] == [(1, ["TP53", "x"])]
    assert {(r.page_id, r.heading) for r in readers.page_identity(pages).collect()} == {(1, "A & B"), (2, None)}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>a<td>b<tr><td>c", [[["a", "b"], ["c"]]]),
        ("<TABLE><TR><TD ROWSPAN=2>a</TD><TD>b &lt; &eacute;</TD></TR><TR><TD>c<br>d</TD></TR></TABLE>", [[["a", "b < é"], ["a", "c d"]]]),
        ("<table><td colspan=2>a<td rowspan=9>b<tr><td>c</table>after", [[["a", "a", "b"], ["c", "", "b"]]]),
        ("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>", [[["a", "1"], ["a", "2"], ["a", "3"]]]),
        ("<table><tr><td>out<table><tr><td>in</table>er<td>x</table>", [[["outer", "x"]], [["in"]]]),
        ("<table><caption>no</caption><thead><tr><th>h</thead><tbody><tr><td> a\n b </tbody></table>", [[["h"], ["a b"]]]),
        ("<table><tr><td>a<script>var t='</td>';</script>b</table>", [[["ab"]]]),
        ("<table><tr><td colspan=x rowspan=-1>a</table>", [[["a"]]]),
        ("<table></table><table><tr></tr></table>", [[], []]),
        ("<p>none</p>", []),
        ("", []),
        (None, []),
    ],
)
def test_tables_of_pages(html, want):
    assert [rows for _, rows in tables.tables_of(html)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab&<é ", max_size=4), st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), max_size=5))
def test_spans_like_a_painted_grid(rows):
    """Every cell paints the next free columns of its row, and as many rows below as it spans."""
    painted = {}
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            for _ in range(across):
                while (y, x) in painted:
                    x += 1
                for k in range(y, min(y + down, len(rows))):
                    painted.setdefault((k, x), " ".join(text.split()))
    want = [[painted.get((y, x), "") for x in range(1 + max(b for a, b in painted if a == y))] for y in range(len(rows))]
    cell = lambda t, a, d: f"<td colspan='{a}' rowspan={d}>{escape(t)}"
    html = "<table>" + "".join("<tr>" + "".join(cell(*c) for c in row) for row in rows)
    assert tables.tables_of(html) == [(0, want)]


def test_records_of_pages(spark):
    html = "<table><tr><th>X</table><table><tr><th>Target ID<th>UniProt ID <th>Gene Symbol (HGNC)</tr><tr><td>1<td>P1<td>tp53<tr><td>2</table><table><tr><th>Target ID<th>Gene Symbol<tr><td>no</table>"
    pages = spark.createDataFrame([(1, html, 0), (2, None, 0), (3, "<table>", 0), (1, html, 0)], "page_id int, html string, cells int")
    got = tables.page_records(pages, {"target": "target id", "gene": "gene symbol", "class": "target class"}, ["target", "gene"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, "1", "tp53", "")] * 2 + [(1, 2, "2", "", "")] * 2
    assert tables.page_tables(pages).count() == 12 and tables.page_tables(pages.where("false")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.csv").write_text("1")
    (tmp_path / "a.csv").write_text("1")
    files = readers.inventory(spark, str(tmp_path))
    assert readers.resolved(files, "a.csv").endswith("/a.csv")
    (tmp_path / "a.csv").write_text("2")
    with pytest.raises(ValueError):
        readers.resolved(readers.inventory(spark, str(tmp_path)), "a.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "t")
    assert sinks.append_new(df, out, ["k"]) == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), out, ["k"]) == 1
    sinks.write_csv(df, str(tmp_path / "c"), gzip=True)
    assert readers.delimited(spark, str(tmp_path / "c")).count() == 2
    sinks.write_by(df, str(tmp_path / "p"), "k")
    sinks.write_json(spark, {"b": 1}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == '{\n "b": 1\n}'
    assert sinks.manifest(spark, str(tmp_path / "m.json")).first().length == 11
    sinks.write_report({"one": df}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/one")).count() == 2


def test_stream(spark, tmp_path):
    from kalibra.streaming import counts

    rows = [("p", 1, "x"), ("p", 1, "x"), ("p", 2, "x"), ("q", 1, "y")]
    spark.createDataFrame(rows, "profile string, article int, left string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("profile string, article int, left string").parquet(str(tmp_path / "in"))
    counts.into_table(counts.support_counts(stream), "support", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.table("support").collect()} == {("p", "x", 2), ("q", "y", 1)}


def test_copies_are_compared_all(spark):
    files = spark.range(1200).selectExpr("concat('/d', id, '/f.csv') as path", "case when id = 1150 then 'b' else 'a' end as sha256")
    assert readers.resolved(files.where("sha256 = 'a'"), "f.csv") == "/d0/f.csv"
    with pytest.raises(ValueError):
        readers.resolved(files, "f.csv")
    with pytest.raises(FileNotFoundError):
        readers.resolved(files, "g.csv")


def test_marks_and_workbooks_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("<&>", None)], "name string, x double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith("\ufeffname,x".encode())
    sinks.write_workbook({"One": df, "Two & more": df.select("x")}, str(tmp_path / "w.xlsx"))
    sheets = readers.workbook(spark, str(tmp_path / "w.xlsx"), ["One", "Two & more"])
    assert sorted(map(str, sheets["One"].collect())) == sorted(["Row(name='a', x='1.5')", "Row(name='<&>', x=None)"])
    with pytest.raises(ValueError):
        sinks.write_workbook({"Long": spark.range(sinks.ROWS + 1)}, str(tmp_path / "x.xlsx"))


def test_named_networks_and_joined_sets(spark):
    links = spark.createDataFrame([("9606.A", "9606.B", 900), ("9606.A", "9606.C", 800)], "a string, b string, score int")
    names = spark.createDataFrame([("9606.A", "TP53"), ("9606.B", "MDM2")], "id string, symbol string")
    assert [tuple(r) for r in readers.named_network(links, names).collect()] == [("TP53", "MDM2", 900)]
    sets = spark.createDataFrame([("H1", "A; B;;A")], "hallmark string, genes string")
    assert sorted(map(tuple, readers.joined_sets(sets, "hallmark", "genes").collect())) == [("H1", "A"), ("H1", "B")]


def test_windowed_counts(spark, tmp_path):
    from kalibra.streaming import counts

    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b")], "t string, k string").selectExpr("cast(t as timestamp) as t", "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    counts.into_table(counts.windowed_counts(stream, "t", "1 minute", "1 minute", "k"), "windowed", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 1)]


def test_batches_are_whole_or_absent(spark, tmp_path):
    """A batch whose rename never came is not there; null keys are kept once; nothing is written twice."""
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "k int, v string")
    assert sinks.appended(spark, out) is None
    df.write.parquet(f"{out}/_staged-cut")
    assert sinks.appended(spark, out) is None
    assert sinks.append_new(df, out, ["k"]) == 2 and sinks.append_new(df, out, ["k"]) == 0
    assert sinks.appended(spark, out).columns == ["k", "v"] and sinks.appended(spark, out).count() == 2
    empty = str(tmp_path / "e")
    assert sinks.append_new(df.where("false"), empty, ["k"]) == 0 and sinks.appended(spark, empty).count() == 0


@pytest.fixture
def server():
    """/ok answers, /late after two failures, /gone never, /busy with 503 for ever; it counts what it was asked."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            late = self.path.startswith("/late") and asked[self.path] < 3
            status = 404 if self.path == "/gone" else 503 if late or self.path == "/busy" else 200
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(f"<h1>{self.path} é</h1>".encode("latin-1"))

        def log_message(self, *args):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", asked
    found.shutdown()


def test_fetch_and_resume(spark, tmp_path, server):
    base, asked = server
    rows = [(0, f"{base}/ok"), (1, f"{base}/late"), (2, f"{base}/gone"), (3, f"{base}/busy"), (4, None), (5, "no address"), (6, "http://127.0.0.1:1/")]
    urls = spark.createDataFrame(rows, "id int, url string")
    got = {r.id: r for r in fetch.fetched(urls, "id", "url", tries=3, wait=0.01, tasks=2).collect()}
    assert got[0].html == "<h1>/ok é</h1>" and [a.status for a in got[1].attempts] == [503, 503, 200] and got[1].html
    assert [a.waited for a in got[3].attempts] == [0.0, 0.01, 0.02] and got[3].status == 503 and got[3].html is None
    assert len(got[2].attempts) == 1 and got[4].attempts == [] and got[5].status is None and len(got[6].attempts) == 3

    many = spark.range(20).selectExpr("id", f"concat('{base}/p', id) as url")
    calls = []

    def work(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise RuntimeError("cut off")
        return fetch.fetched(part, "id", "url", wait=0.01)

    out = str(tmp_path / "pages")
    with pytest.raises(RuntimeError):
        sinks.resumed(many, out, ["id"], work, size=5)
    had = sinks.appended(spark, out).count()
    assert 0 < had < 20
    assert sinks.resumed(many, out, ["id"], work, size=5).select("id").distinct().count() == 20
    assert sinks.appended(spark, out).count() == 20 and all(asked[f"/p{i}"] == 1 for i in range(20))


def test_sheets_stream(tmp_path):
    """Of a long sheet only a row is held."""
    import tracemalloc

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    f = tmp_path / "a.xml"
    f.write_text(f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}"><c r="AB{i}"><v>{i}</v></c></row>' for i in range(60_000)) + "</sheetData></worksheet>")
    tracemalloc.start()
    with f.open("rb") as x:
        assert sum(1 for _ in readers._ended(x, f"{readers.MAIN}row")) == 60_000
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()
    assert [readers._column(r, 7) for r in ("A1", "Z1", "AB1", None)] == [0, 25, 27, 7]
