"""Turtle and N-Triples, output and streams."""

import json

import pytest

from quillgraph.functions.terms import RDF
from quillgraph.operators import output, stats
from quillgraph.operators.match import select
from quillgraph.sources.rdf import read_ntriples, read_turtle, statement, turtle_text
from quillgraph.streaming.triples import stream_solutions, triple_stream

TTL = r'''@prefix ex: <http://e.org/b#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX t: <http://e.org/t/>
# a comment that ends with a dot.
ex:ahu a ex:AHU ;
    ex:feeds ex:vav , ex:vav2 .
ex:room rdfs:label "Room 1"@en , "say \"hi\" # not a comment" ; ex:size 12.5 ; ex:in [ a ex:Floor ] .
t:x t:list ( ex:a ex:b ) .
_:k ex:feeds <http://e.org/b#z> .
'''


def test_turtle(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(TTL)
    g = read_turtle(spark, str(tmp_path / "b.ttl"))
    rows = {(r.s, r.p, r.o) for r in g.triples().collect()}
    e = "http://e.org/b#"
    assert {(e + "ahu", RDF + "type", e + "AHU"), (e + "ahu", e + "feeds", e + "vav"), (e + "ahu", e + "feeds", e + "vav2")} <= rows
    texts = {o for s, p, o in rows if p.endswith("#label")}
    assert texts == {"Room 1", 'say "hi" # not a comment'}
    assert len(rows) == 14 and g.prefixes["t"] == "http://e.org/t/"
    assert [r.f for r in select(g, ["f"], [("ex:room", "ex:in", "?f"), ("?f", "a", "ex:Floor")]).collect()][0].startswith("_:")


@pytest.mark.parametrize("text", ["ex:a ex:b ]", "ex:a", "ex:a ex:b", "ex:a ex:b ex:c ex:d", "ex:a % ex:b"])
def test_bad_turtle(text):
    with pytest.raises(ValueError):
        statement(text, {"ex": "http://e#"}, "f")


FORMS = {
    "two on a line": "@prefix e: <http://e#> . e:a e:p e:b . e:b e:p e:c .\n",
    "comment after a dot": "@prefix e: <http://e#> . # names\ne:a e:p e:b . # one.\ne:b e:p e:c .\n",
    "CRLF": "@prefix e: <http://e#> .\r\ne:a e:p e:b .\r\n\r\ne:b e:p\r\n  e:c .\r\n",
    "base": "@base <http://e> .\nPREFIX e: <http://e#>\n<#a> e:p <#b> .\n<#b> <#p> e:c .\n",
    "long texts": "@prefix e: <http://e#> .\ne:a e:p e:b ; e:t \'\'\'it\'s\n\"two\" lines\'\'\' .\ne:b e:p e:c .\n",
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_forms_of_turtle(spark, tmp_path, form):
    (tmp_path / "f.ttl").write_bytes(FORMS[form].encode())
    e = "http://e#"
    wanted = {(e + "a", e + "p", e + "b"), (e + "b", e + "p", e + "c")} | ({(e + "a", e + "t", "it's\n\"two\" lines")} if form == "long texts" else set())
    for g in (read_turtle(spark, str(tmp_path / "f.ttl")), turtle_text(spark, FORMS[form])):
        assert {tuple(r) for r in g.triples().collect()} == wanted


def test_turtle_written_and_read(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(TTL.replace("[ a ex:Floor ]", "ex:floor").replace("( ex:a ex:b )", '"a\\\\b\\n\\t\\"c"').replace("_:k", "ex:k"))
    g = read_turtle(spark, str(tmp_path / "b.ttl"))
    (tmp_path / "c.ttl").write_text("\n".join(r.value for r in output.turtle_lines(g).collect()) + "\n")
    again = read_turtle(spark, str(tmp_path / "c.ttl"))
    assert {tuple(r) for r in again.triples().collect()} == {tuple(r) for r in g.triples().collect()} and again.prefixes == g.prefixes


def test_histograms(spark, tmp_path):
    g = turtle_text(spark, FORMS["base"])
    stats.write_histograms(g.triples(), str(tmp_path / "h"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "h/outdegree")).collect()) == ["1", "1"]
    assert {tuple(r) for r in stats.histogram(stats.degrees(g.triples(), "o"), "degree").collect()} == {(1, 2)}


def test_ntriples(spark, tmp_path):
    (tmp_path / "b.nt").write_text('<http://e#a> <http://e#p> <http://e#b> .\n# no\n_:x <http://e#p> "a \\"q\\" \\\\n \\n"@en .\n\n')
    rows = {(r.s.split("f")[0], r.p, r.o) for r in read_ntriples(spark, str(tmp_path / "b.nt")).triples().collect()}
    assert rows == {("http://e#a", "http://e#p", "http://e#b"), ("_:", "http://e#p", 'a "q" \\n \n')}


def test_output_and_stats(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(TTL)
    g = read_turtle(spark, str(tmp_path / "b.ttl"))
    found = select(g, ["x"], [("ex:ahu", "ex:feeds", "?x")])
    values = sorted(json.loads(r.value)["?x"]["Value"] for r in output.json_rows(found).collect())
    assert values == ["vav", "vav2"]
    assert sorted(r.x for r in output.csv_rows(found, g.prefixes).collect()) == ["ex:vav", "ex:vav2"]
    lines = [r.value for r in output.graph_dot(g).collect()]
    assert lines[0].startswith("digraph") and '"ex:ahu" -> "ex:vav" [label="ex:feeds"];' in lines
    assert stats.sizes(g.triples()).first()["n_triples"] == 14
    assert output.pattern_dot(["x"], [("?x", "a", "ex:AHU")]).count("->") == 1


def test_stream(spark, tmp_path):
    (tmp_path / "b.ttl").write_text(TTL)
    g = read_turtle(spark, str(tmp_path / "b.ttl"))
    e = "http://e.org/b#"
    spark.createDataFrame([(e + "vav", e + "reads", "7"), (e + "other", e + "reads", "8")], "s string, p string, o string").write.parquet(str(tmp_path / "in"))
    joined = stream_solutions(triple_stream(spark, str(tmp_path / "in")), g, ("?v", "ex:reads", "?n"), [("?a", "ex:feeds", "?v")])
    query = joined.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.n, r.a) for r in spark.table("seen").collect()] == [("7", e + "ahu")]


def test_stream_terms(spark, tmp_path):
    """One variable twice asks for equal terms; conditions that share no variable go with every triple."""
    rows = [("a", "p", "b"), ("c", "p", "c")]
    spark.createDataFrame(rows, "s string, p string, o string").write.parquet(str(tmp_path / "in"))
    g = turtle_text(spark, "<x:1> <y:q> <x:2> .")
    for k, (where, wanted) in enumerate((((), [("c",)]), ([("?n", "<y:q>", "?m")], [("c", "x:1", "x:2")]))):
        joined = stream_solutions(triple_stream(spark, str(tmp_path / "in")), g, ("?x", "p", "?x"), where)
        query = joined.writeStream.format("memory").queryName(f"terms{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert [tuple(r) for r in spark.table(f"terms{k}").collect()] == wanted
