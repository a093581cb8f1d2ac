"""Generated requests over every link: grouped, filtered and refused ones, against SQL built on its own."""

import pytest
from pyspark.sql import functions as F

from quarrystone.plans.model import LINKS, OBJECTS, sales, table
from quarrystone.plans.outcomes import Refusal

MEASURES = {
    "lines": ("lineitem", "COUNT(*)"), "quantity": ("lineitem", "CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"),
    "order_value": ("orders", "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"), "open_orders": ("orders", "COUNT(*) FILTER (o_orderstatus = 'O')"),
    "supplier_balance": ("supplier", "CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE)"),
}
ATTRIBUTES = {"orders": "o_orderpriority", "customer": "c_mktsegment", "supplier": "s_name", "part": "p_brand", "nation": "n_name", "region": "r_name"}


def paths(start, goal):
    """All chains of links, shortest first."""
    found, queue = [], [(start, [])]
    while queue:
        at, taken = queue.pop(0)
        if at == goal and taken:
            found.append(taken)
            continue
        queue += [(x[3], [*taken, x]) for x in LINKS if x[1] == at]
    return found


CASES = [(m, o) for m, (grain, _) in MEASURES.items() for o in ATTRIBUTES if o != grain]


@pytest.fixture(scope="module")
def ontology(spark, small):
    return sales(spark, small)


@pytest.mark.parametrize("measure,goal", CASES)
def test_request(measure, goal, ontology, duck):
    grain, expression = MEASURES[measure]
    ways, attribute = paths(grain, goal), ATTRIBUTES[goal]
    grouped = ontology.compile(measure, [(goal, attribute)])
    if not ways:
        assert isinstance(grouped, Refusal) and grouped.reason == "no_path"
        return
    assert sum(len(w) == len(ways[0]) for w in ways) == 1
    joins = " ".join(f"LEFT JOIN {b} ON {a}.{ac} = {b}.{bc}" for _, a, ac, b, bc in ways[0])
    want = duck.sql(f"SELECT {goal}.{attribute} AS k, {expression} AS v FROM {grain} {joins} GROUP BY 1").fetchall()
    got = [(r[0], r[1]) for r in grouped.frame.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    total = ontology.compile(measure).frame.first()[0]
    assert total == pytest.approx(sum(v for _, v in got))
    value = got[0][0]
    head, rest = ways[0][0], ways[0][1:]
    inner = " ".join(f"LEFT JOIN {b} ON {a}.{ac} = {b}.{bc}" for _, a, ac, b, bc in rest)
    sql = f"SELECT {expression} FROM {grain} WHERE {head[2]} IN (SELECT {head[3]}.{head[4]} FROM {head[3]} {inner} WHERE {goal}.{attribute} = ?)"
    filtered = ontology.compile(measure, filters=[(goal, attribute, "=", value)])
    assert filtered.frame.first()[0] == duck.execute(sql, [value]).fetchall()[0][0] == pytest.approx(dict(got)[value])
    nothing = ontology.compile(measure, filters=[(goal, attribute, "=", "no such value")]).frame.first()[0]
    assert nothing in (0, None)


@pytest.mark.parametrize("parent", ["customer", "nation", "part"])
def test_planted_corruption_is_caught(spark, small, parent):
    o = sales(spark, small)
    df = table(spark, small, parent)
    o.add_object(parent, df.union(df.orderBy(OBJECTS[parent]).limit(1)), OBJECTS[parent])
    assert {(v.check, v.subject) for v in o.verify()} == {("key_unique", parent)}
    assert o.compile("lines", [(parent, ATTRIBUTES[parent])]).reason == "ontology_unverified"
    link = next(x for x in o.links.values() if x.to_object == parent)
    assert (link.cardinality, link.max_fanout) == ("many_to_many", 2) and link not in o.usable_links()
    naive = o.objects[link.from_object].relation().join(o.objects[parent].relation(), F.col(link.from_columns[0]) == F.col(link.to_columns[0]), "left").count()
    assert naive >= o.objects[link.from_object].relation().count()
