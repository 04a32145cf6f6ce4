"""The query language and the builders."""

import pytest

from graphloom.engine import QueryEngine
from graphloom.model import Direction, NodeRef, PropertyGraph
from graphloom.plans.parser import QueryError, parse, tokenize


@pytest.fixture(scope="module")
def engine(spark):
    g = PropertyGraph(spark)
    for i, name, age, city, salary in [(1, "Alice", 30, "NYC", 80000), (2, "Bob", 25, "LA", 60000), (3, "Charlie", 35, "NYC", 90000), (4, "Diana", 28, "Chicago", 75000), (5, "Eve", 32, "NYC", 85000), (6, "Frank", 40, "LA", 100000)]:
        g.add_node("person", i, name=name, age=age, city=city, salary=salary)
    for i, name, n, industry in [(100, "TechCorp", 500, "tech"), (101, "FinanceInc", 200, "finance"), (102, "StartupXYZ", 50, "tech")]:
        g.add_node("company", i, name=name, employees=n, industry=industry)
    g.add_node("project", "p1", name="Project Alpha", budget=100000)
    g.add_node("project", "p2", name="Project Beta", budget=50000)
    for a, b, since, close in [(1, 2, 2018, True), (1, 3, 2019, False), (2, 4, 2020, True), (3, 5, 2017, True), (4, 5, 2021, False), (5, 6, 2016, True)]:
        g.add_edge("KNOWS", ("person", a), ("person", b), since=since, close=close)
    for a, b, role in [(1, 100, "Engineer"), (2, 100, "Designer"), (3, 101, "Manager"), (4, 102, "Developer"), (5, 100, "Lead"), (6, 101, "Director")]:
        g.add_edge("WORKS_AT", ("person", a), ("company", b), role=role)
    for a, b, hours in [(1, "p1", 20), (2, "p1", 15), (3, "p2", 10)]:
        g.add_edge("WORKS_ON", ("person", a), ("project", b), hours=hours)
    return QueryEngine(g)


def names(result):
    return [r["name"] for r in result]


@pytest.mark.parametrize("where,n", [
    ("age > 30", 3), ("age >= 30", 4), ("age < 28", 1), ("age <= 28", 2), ("age = 30", 1), ("age == 30.0", 1), ("age != 30", 5), ("age <> 30", 5),
    ("city IN (NYC, LA)", 5), ("city IN ('Chicago')", 1), ("city NOT IN (NYC)", 3), ("name CONTAINS li", 2), ("name STARTS_WITH A", 1), ("name ENDS_WITH e", 3),
    ("name MATCHES 'A.*'", 1), ("name MATCHES 'li'", 0), ("city = LA OR city = Chicago", 3), ("age > 30 AND city = NYC OR city = Chicago", 3), ("EXISTS city", 6),
    ("NOT EXISTS city", 0), ("nothing EXISTS", 0), ("nothing NOT EXISTS", 6), ("nothing = 1", 0), ("nothing != 1", 0), ("age = '30'", 0), ("id = 1", 0), ("age > abc", 0), ("name > 5", 0), ("name != 5", 6), ("name >= Diana", 3),
])
def test_conditions(engine, where, n):
    assert engine.execute(f"COUNT person WHERE {where}").first() == n
    assert engine.execute(f"NODES person WHERE {where}").count == n


def test_nodes(engine):
    r = engine.execute("NODES person WHERE age > 25 ORDER BY age DESC LIMIT 2 OFFSET 1 RETURN name, age, none")
    assert r.to_list() == [{"name": "Charlie", "age": 35, "none": None}, {"name": "Eve", "age": 32, "none": None}] and r.total_count == 5
    assert engine.execute("NODES person LIMIT 0").count == 0 and engine.execute("NODES person LIMIT 0").total_count == 6
    assert engine.execute("NODES").count == 11 and engine.execute("NODES nobody").count == 0
    assert names(engine.execute('NODES person(city="NYC", age=30) RETURN name')) == ["Alice"]
    assert names(engine.execute("NODES person(city=LA) WHERE age > 30 OR age < 20 RETURN name")) == ["Frank"]
    assert engine.execute("NODES OFFSET 9").count == 2
    assert names(engine.execute("NODES ORDER BY employees DESC RETURN name"))[:3] == ["TechCorp", "FinanceInc", "StartupXYZ"]
    assert len(names(engine.execute("NODES ORDER BY employees ASC RETURN name"))) == 11


def test_absent_keys_come_last(spark):
    g = PropertyGraph(spark)
    g.add_node("p", 1, v=2), g.add_node("p", 2), g.add_node("p", 3, v=1)
    e = QueryEngine(g)
    assert [r["id"] for r in e.execute("NODES p ORDER BY v")] == ["3", "1", "2"]
    assert [r["id"] for r in e.execute("NODES p ORDER BY v DESC")] == ["1", "3", "2"]


def test_explicit_nulls_exist(spark):
    g = PropertyGraph(spark)
    g.add_node("p", 1, v=None), g.add_node("p", 2), g.add_node("p", 3, v="x")
    e = QueryEngine(g)
    for where, n in (("EXISTS v", 2), ("NOT EXISTS v", 1), ("v != y", 2), ("v NOT IN (x)", 1), ("v = NULL", 1), ("v CONTAINS x", 1)):
        assert e.execute(f"COUNT p WHERE {where}").first() == n, where


def test_edges(engine):
    assert engine.execute("EDGES KNOWS").count == 6 and engine.execute("EDGES").count == 15
    assert engine.execute("EDGES KNOWS WHERE since > 2018").count == 3
    assert engine.execute("EDGES KNOWS WHERE close = TRUE").count == 4 and engine.execute("EDGES KNOWS WHERE close = 1").count == 4
    r = engine.execute("EDGES KNOWS LIMIT 2")
    assert r.count == 2 and r.total_count == 6
    assert engine.execute("EDGES WORKS_AT WHERE role = Engineer").first()["dst_id"] == "100"


def test_aggregates(engine):
    r = engine.execute("SUM person.salary WHERE city = NYC")
    assert r.first() == 255000 and r.total_count == 3
    assert engine.execute("AVG person.age").first() == pytest.approx(31.6667, abs=1e-3)
    assert engine.execute("MIN person.age").first() == 25 and engine.execute("MAX person.age").first() == 40
    r = engine.execute("SUM person.name")
    assert r.first() is None and r.total_count == 0
    assert engine.execute("COUNT").first() == 11


@pytest.mark.parametrize("text,expected", [
    ("TRAVERSE person:1 -> KNOWS -> person", ["2", "3"]), ("TRAVERSE :person:1 -> KNOWS -> person -> KNOWS -> person", ["4", "5"]),
    ("TRAVERSE person:1 -> WORKS_AT -> company", ["100"]), ("TRAVERSE person:1 -> KNOWS -> company", []), ("TRAVERSE person:5 <- KNOWS <- person", ["3", "4"]),
    ("TRAVERSE person:5 -- KNOWS -- person", ["3", "4", "6"]), ("TRAVERSE person:9 -> KNOWS", []), ("TRAVERSE person:1", ["1"]),
    ("TRAVERSE person:1 -> KNOWS -> person MAX 3", ["2", "3", "4", "5", "6"]), ("TRAVERSE person:1 -> KNOWS MAX 1", ["2", "3"]), ("TRAVERSE person:1 -> KNOWS LIMIT 1", ["2"]),
])
def test_traverse(engine, text, expected):
    assert [r.id for r in engine.execute(text)] == expected


def test_path(engine):
    r = engine.execute("PATH person:1 TO person:6 VIA KNOWS")
    assert r.first()["length"] == 3 and [n["id"] for n in r.first()["nodes"]] == ["1", "3", "5", "6"]
    assert engine.execute("PATH person:1 TO person:6 VIA KNOWS MAX 2").count == 0
    assert engine.execute("PATH person:6 TO person:1").count == 0
    assert engine.execute("PATH person:1 TO company:101").first()["length"] == 2


@pytest.mark.parametrize("text", [
    "", "FROB", "NODES person WHERE", "NODES person WHERE age", "NODES person WHERE age LIKE 3", "NODES person WHERE city IN (NYC", "NODES person WHERE city IN NYC", "NODES person(name=A",
    "NODES person RETURN name LIMIT 3", "NODES person OFFSET 2 LIMIT 3", "NODES person WHERE NOT age > 5", "NODES person LIMIT x", "PATH person:1 person:2", "TRAVERSE person", "NODES person ; x", "NODES person WHERE name MATCHES '('",
])
def test_errors(engine, text):
    with pytest.raises((QueryError, Exception)):
        engine.execute(text).to_list()


def test_parser():
    s = parse("TRAVERSE person:1 -> KNOWS -> person <- R <- * MAX 4 LIMIT 2")
    assert [(x.direction, x.relation, x.target) for x in s.steps] == [(Direction.OUT, "KNOWS", "person"), (Direction.IN, "R", None)]
    assert (s.start, s.most, s.limit) == (NodeRef("person", "1"), 4, 2)
    assert [c.value for c in parse("NODES a WHERE b IN (1, 2.5, 'x', \"y z\", TRUE, NULL, -3)").groups[0]] == [[1, 2.5, "x", "y z", True, -3]]
    assert parse("nodes a where b = 'it\\'s'").groups[0][0].value == "it's"
    assert [t.text for t in tokenize("a>=1 b<>c")] == ["a", ">=", "1", "b", "<>", "c"]
    assert parse("SUM a.b.c").property == "b.c"


def test_builders(engine):
    q = engine.match("person").where("age", ">", 25).where("city", "=", "NYC").order_by("age", "DESC").limit(2).return_fields("name")
    assert names(q.execute()) == ["Charlie", "Eve"]
    assert engine.match("person").where_exists("city").count() == 6 and engine.match("person").where_not_exists("city").count() == 0
    assert engine.match("person").where("city", "IN", ["LA"]).offset(1).execute().count == 1
    assert engine.match("person").limit(0).execute().count == 0
    assert engine.match_edges("KNOWS").where("since", ">=", 2020).limit(9).execute().count == 2
    with pytest.raises(ValueError, match="CONTAINS"):
        engine.match("person").where("age", "LIKE", 1)
    text = engine.execute("NODES person WHERE age > 28 ORDER BY name LIMIT 3")
    assert text.to_list() == engine.match("person").where("age", ">", 28).order_by("name").limit(3).execute().to_list()


def test_only_one_type_is_scanned(engine):
    plan = engine.execute("NODES company WHERE employees > 100").df._jdf.queryExecution().optimizedPlan().toString()
    assert "salary" not in plan
