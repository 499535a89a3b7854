"""A generated campus with counts in closed form, and plans that read no more than they must."""

import pytest

from quillgraph.functions.paths import pred
from quillgraph.operators.match import count, either, match, relation, select
from quillgraph.operators.update import infer
from quillgraph.plans.graph import TripleGraph
from quillgraph.sources.warehouse import VOCAB, warehouse

C = "http://campus#"
TYPE, SUB, INVERSE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://www.w3.org/2002/07/owl#inverseOf"
AHUS, UNFED, UNSENSED = 5, 3, 11
FOLDER = "/root/testdata/sf0.001"


def campus(spark, n):
    """AHUS air handlers; n boxes, each feeding a zone with a room in it, all but UNFED fed by an air handler; a sensor of
    a subclass at all but the last UNSENSED boxes."""
    rows = [("feeds", INVERSE, "fedBy"), ("pointOf", INVERSE, "hasPoint"), ("Zone_Sensor", SUB, "Sensor"), ("Fine_Sensor", SUB, "Zone_Sensor")]
    rows += [(f"ahu{k}", TYPE, "AHU") for k in range(AHUS)]
    for k in range(n):
        rows += [(f"vav{k}", TYPE, "VAV"), (f"zone{k}", TYPE, "Zone"), (f"room{k}", TYPE, "Room"), (f"vav{k}", "feeds", f"zone{k}"), (f"room{k}", "partOf", f"zone{k}")]
        if k < n - UNFED:
            rows.append((f"ahu{k % AHUS}", "feeds", f"vav{k}"))
        if k < n - UNSENSED:
            rows += [(f"sensor{k}", TYPE, "Fine_Sensor" if k % 2 else "Zone_Sensor"), (f"sensor{k}", "pointOf", f"vav{k}")]
    full = lambda t: t if "://" in t else C + t
    return infer(TripleGraph(spark.createDataFrame([tuple(map(full, r)) for r in rows], "s string, p string, o string"), {"c": C}))


N = 43
FED, SENSED = N - UNFED, N - UNSENSED
feeds, fed, point, part = pred("c:feeds"), pred("c:fedBy"), pred("c:pointOf"), pred("c:partOf")
AHU, VAV, ROOM, SENSOR = ("?ahu", "a", "c:AHU"), ("?vav", "a", "c:VAV"), ("?room", "a", "c:Room"), ("?sensor", pred("a") / pred("rdfs:subClassOf").star(), "c:Zone_Sensor")
IN_ZONE = [("?vav", feeds.plus(), "?zone"), ("?room", part, "?zone")]
GOLDEN = [
    ("room", [ROOM], N), ("x", [AHU, ("?ahu", feeds, "?x")], FED), ("x", [AHU, ("?ahu", feeds.plus(), "?x")], 2 * FED), ("x", [AHU, ("?x", fed.plus(), "?ahu")], 2 * FED),
    ("x", [AHU, ("?ahu", feeds / feeds, "?x")], FED), ("x", [AHU, ("?ahu", feeds / feeds.plus(), "?x")], FED), ("x", [AHU, ("?ahu", feeds / feeds.optional(), "?x")], 2 * FED),
    ("x", [AHU, ("?x", fed / fed.optional(), "?ahu")], 2 * FED), ("x", [AHU, ("?ahu", feeds.star(), "?x")], 2 * FED + AHUS), ("x", [AHU, ("?x", fed.star(), "?ahu")], 2 * FED + AHUS),
    ("vav room", [VAV, ROOM, *IN_ZONE], N), ("sensor", [SENSOR], SENSED), ("sensor room", [SENSOR, ROOM, ("?sensor", point, "?vav"), *IN_ZONE], SENSED),
    ("sensor room", [SENSOR, ROOM, either([("?sensor", point, "?vav"), *IN_ZONE], [("?sensor", point, "?room")])], SENSED), ("sensor room", [SENSOR, ROOM, ("?sensor", point, "?room")], 0),
    ("vav x y", [VAV, ("?vav", "c:hasPoint", "?x"), ("?vav", fed, "?y")], SENSED), ("ahu", [AHU, ("?ahu", feeds, "c:vav7")], 1), ("ahu", [("?ahu", feeds, "c:vav7"), AHU], 1),
    ("vav x y z", [VAV, ("?vav", pred("c:hasPoint").plus(), "?x"), ("?vav", fed.plus(), "?y"), ("?vav", feeds.plus(), "?z")], SENSED),
]


@pytest.fixture(scope="module")
def graph(spark):
    return campus(spark, N).cache()


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden_counts(graph, k):
    names, where, wanted = GOLDEN[k]
    assert count(graph, names.split(), where).first()["count"] == wanted


def test_islands(spark):
    """Patterns that share no variable are a product; a pattern between islands has no solution."""
    g = TripleGraph(spark.createDataFrame([(C + a, C + "p", C + b) for a, b in ("ab", "bc", "xy")], "s string, p string, o string"), {"c": C})
    assert count(g, [], [("c:a", pred("c:p").plus(), "?n"), ("?m", pred("c:p"), "c:y")]).first()["count"] == 2
    assert count(g, [], [("c:a", pred("c:p").plus(), "?n"), ("?n", pred("c:p").star(), "c:y")]).first()["count"] == 0


def test_closure_starts_from_bindings(spark, graph, monkeypatch):
    """A path that repeats is followed from the nodes that another pattern binds, whatever comes first."""
    from quillgraph.operators import match as module

    asked = []
    monkeypatch.setattr(module, "plus", lambda step, seeds=None: asked.append(seeds) or plain(step, seeds))
    plain = __import__("quillgraph.operators.closure", fromlist=["plus"]).plus
    got = match(graph, [("?x", feeds.plus(), "?z"), ("?x", fed, "c:ahu1")])
    assert got.columns == ["x", "z"] and len(asked) == 1
    boxes = {C + f"vav{k}" for k in range(FED) if k % AHUS == 1}
    assert {r[0] for r in asked[0].collect()} == boxes and {r["x"] for r in got.collect()} == boxes
    assert relation(graph, feeds.plus(), C + "ahu0").count() == 2 * len([k for k in range(FED) if k % AHUS == 0])


def test_unknown_variable_is_an_error(graph):
    with pytest.raises(ValueError, match="nope"):
        select(graph, ["?nope"], [AHU])


def test_versions(spark, graph, tmp_path):
    path = f"file://{tmp_path}/g"
    graph.save(path)
    first = spark.read.text(f"{path}/CURRENT").first()[0]
    TripleGraph(graph.triples().limit(5), graph.prefixes).save(path)
    assert TripleGraph.load(spark, path).triples().count() == 5
    assert TripleGraph.load(spark, path, first).triples().count() == graph.triples().count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constants_reach_the_scan(spark):
    g = warehouse(spark, FOLDER)
    plan = plan_of(select(g, ["c"], [("?c", "v:locatedIn", "nation:7")]))
    assert "EqualTo(c_nationkey,7)" in plan and "EqualTo(s_nationkey,7)" in plan and "region" not in plan and "HashAggregate" not in plan
    plan = plan_of(select(g, ["p", "o"], [("customer:42", "?p", "?o")]))
    assert "EqualTo(c_custkey,42)" in plan and "EqualTo(o_custkey,42)" in plan and "lineitem" not in plan and "Exchange" not in plan
    assert "Scan" not in plan_of(select(g, ["o"], [("customer:042", f"<{VOCAB}placed>", "?o")])).replace("LocalTableScan", "").replace("Scan ExistingRDD", "")


def test_bindings_choose_the_tables(spark):
    """Only tables that can make a bound node are read by an open predicate."""
    g = warehouse(spark, FOLDER)
    found = select(g, ["s", "p", "o"], [("?s", "v:locatedIn", "nation:7"), ("?s", "?p", "?o")])
    tables = {f.rsplit("/", 1)[1].removesuffix(".parquet") for f in found.inputFiles() if "/testdata/" in f}
    some = spark.read.parquet(f"{FOLDER}/supplier.parquet").where("s_nationkey = 7").count() > 0
    assert tables == {"customer", "orders"} | ({"supplier", "lineitem"} if some else set())
    assert found.where("p LIKE '%placed'").count() > 0
