import random

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import graph as gr
from sensorlake.operators import metrics, rank
from sensorlake.storage import fresh_path, materialize
from sensorlake.operators.metrics import exact_percentiles, latency_histogram
from sensorlake.operators.ontology import (canonical_fields, read_classes, read_properties, unrecognized_fields,
                                           valid_sensor_types)
from sensorlake.operators.normalize import rules_frame
from sensorlake.operators.profile import field_profile, merged_schema
from sensorlake.operators.rank import first_per_type, last_n_points, paginate, top_per_group


def plan(df):
    return df._jdf.queryExecution().toString()


def by_hand(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_percentiles_are_exact_under_skew(spark, accuracy):
    rng = random.Random(7)
    data = [("hot", 0.0)] * 3000 + [("hot", rng.expovariate(1.0)) for _ in range(4000)] + [("one", 5.0)] \
        + [("two", 1.0), ("two", 2.0)] + [("gap", float(x)) for x in (1, 1, 1, 1000)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, "v", shares, ["k"], accuracy).collect()}
    for key in {k for k, _ in data}:
        mine = [v for k, v in data if k == key]
        for name, share in shares.items():
            assert got[key][name] == pytest.approx(by_hand(mine, share), abs=1e-12), (key, name)
    whole = exact_percentiles(df, "v", shares, accuracy=accuracy).collect()[0]
    assert whole.p95 == pytest.approx(by_hand([v for _, v in data], 0.95), abs=1e-12)


@pytest.mark.parametrize("groups", [2, 10_000])
def test_percentiles_narrow_until_a_segment_is_small(spark, groups, monkeypatch):
    monkeypatch.setattr(metrics, "BROADCAST_GROUPS", groups)
    rng = random.Random(8)
    data = [("a", float(rng.randint(0, 10 ** 6))) for _ in range(20_000)] + [("b", 1.0)] * 50 + [("c", None), ("d", float("nan")), ("d", 2.0)] \
        + [("e", rng.choice([0.25, -7.5])) for _ in range(900)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"p50": 0.5, "p999": 0.999}
    got = {r.k: r for r in exact_percentiles(df, "v", shares, ["k"], accuracy=20, segment=100).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    for key in "abe":
        mine = [v for k, v in data if k == key]
        assert got[key].p50 == pytest.approx(by_hand(mine, 0.5)) and got[key].p999 == pytest.approx(by_hand(mine, 0.999))


def test_percentiles_shuffle_no_rows(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"))
    plan = exact_percentiles(df, "v", {"p50": 0.5}, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_deep_pages_read_their_ranges_only(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 7).cast("int").alias("y"))
    pages = rank.Pages(df, [F.desc("y"), F.asc("x")], part_rows=100)
    want = sorted(((i, i % 7) for i in range(1000)), key=lambda r: (-r[1], r[0]))
    for page, size in ((1, 10), (91, 10), (10, 99), (2, 999), (500, 10)):
        got = [tuple(r) for r in pages.page(page, size).collect()]
        assert got == [(*r, 1000) for r in want[(page - 1) * size:page * size]]
    chosen, before = pages.parts(91, 10)
    assert len(chosen) <= 2 and before < 300
    assert "_part" in str(pages.page(91, 10)._jdf.queryExecution().executedPlan()).split("PartitionFilters")[1][:60]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (4.0,), (None,), (9999.0,)], "s double")
    rows = {r.le: r.n for r in latency_histogram(df, F.col("s"), (1, 5)).collect()}
    assert rows == {1.0: 2, 5.0: 3, None: 4}


@pytest.mark.parametrize("n", [3, 1200])
def test_top_per_group_with_a_hot_group(spark, n):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                    (F.col("id") % 977).alias("v"), "id").repartition(8)
    got = {(r.k, r.id) for r in top_per_group(rows, ["k"], [F.desc("v"), F.asc("id")], n).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append((-r.v, r.id))
    assert got == {(k, i) for k, vs in groups.items() for _, i in sorted(vs)[:n]}


def test_top_per_group_is_cut_before_the_shuffle(spark):
    df = top_per_group(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], 5)
    assert "WindowGroupLimit" in plan(df)


def test_copies_of_one_row_are_spread(spark):
    rows = spark.range(5000).select(F.lit("same").alias("k"), F.lit(1).alias("v")).repartition(8)
    assert top_per_group(rows, ["k"], [F.asc("v")], 1500).count() == 1500


def test_points_and_pages(spark):
    df = spark.range(10).select(F.col("id").alias("t"))
    assert [r.t for r in last_n_points(df, "t", 3).collect()] == [7, 8, 9]
    assert last_n_points(df, "t", 0).count() == 10
    page = paginate(df, [F.asc("t")], page=2, size=4).collect()
    assert [r.t for r in page] == [4, 5, 6, 7] and page[0].total_items == 10


def test_first_per_type(spark):
    df = spark.createDataFrame([(3, "stat"), (1, "odd"), (2, "stat")], "id int, tile_type string")
    got = {r.tile_type: r.computation_id for r in first_per_type(df, ["table", "stat", "timeseries"]).collect()}
    assert got == {"table": 1, "stat": 2, "timeseries": 1}


# ---------------------------------------------------------------- graph

@pytest.fixture(scope="module")
def city(spark):
    nodes = spark.createDataFrame(
        [("c", "SmartCity", ["SmartCity"], {"name": "Town"}), ("a", "Address", ["Address"], {"street": "Main", "city": "Town"}),
         ("b1", "Building", ["Building"], {"name": "One"}), ("b2", "Building", ["Building"], {"name": "Two"})]
        + [(f"s{i}", "Sensor", ["Sensor", "TemperatureSensor"], {"sensorId": f"S{i}"}) for i in range(5)],
        "id string, label string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("b1", "hasAddress", "a"), ("b2", "hasAddress", "a"), ("a", "locatedIn", "c")]
                                  + [(f"s{i}", "locatedIn", "b1") for i in range(4)], "src string, rel string, dst string")
    return nodes, edges


def test_context_of_placed_and_unplaced_sensors(city):
    got = {r.sensor: (r.sensor_type, r.building, r.smart_city) for r in gr.sensor_context(*city).collect()}
    assert got["S0"] == ("TemperatureSensor", "One", "Town") and got["S4"] == ("TemperatureSensor", None, None)
    assert gr.full_chain(*city).count() == 4
    assert [r.building for r in gr.buildings_without_sensors(*city).collect()] == ["Two"]
    assert gr.sensors_in_building(*city, "Two").count() == 0


def test_long_sensor_lists_come_in_parts(city):
    rows = gr.city_overview(*city, list_size=2).collect()
    assert sorted(s for r in rows for s in r.sensors) == ["S0", "S1", "S2", "S3"] and {r.part for r in rows} <= {0, 1}


def test_delete_cascade(spark, city):
    nodes, edges = city
    one = spark.createDataFrame([("b1", "a")], "src string, dst string")
    n, e = gr.delete_address_links(nodes, edges, one)
    assert {r.id for r in n.collect()} == {"c", "a", "b2"} | {f"s{i}" for i in range(5)}
    assert {tuple(r) for r in e.collect()} == {("b2", "hasAddress", "a"), ("a", "locatedIn", "c")}
    both = spark.createDataFrame([("b1", "a"), ("b2", "a")], "src string, dst string")
    n, e = gr.delete_address_links(nodes, edges, both)
    assert "a" not in {r.id for r in n.collect()} and e.count() == 0


def test_cascade_by_stored_degrees(spark, city):
    nodes, edges = city
    stored = gr.degrees(edges)
    cut = spark.createDataFrame([("b1", "a"), ("b1", "a"), ("b2", "nowhere")], "src string, dst string")
    n, e, left = gr.cascade_delete(nodes, edges, cut, stored)
    assert {tuple(r) for r in e.collect()} == {("b2", "hasAddress", "a"), ("a", "locatedIn", "c")} and n.count() == nodes.count() - 1
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in gr.degrees(e).collect()}
    more = gr.link(n, e, spark.createDataFrame([("s4", "locatedIn", "b2")], edges.schema))
    grown = gr.changed_degrees(left, added=spark.createDataFrame([("s4", "locatedIn", "b2")], edges.schema))
    assert {tuple(r) for r in grown.collect()} == {tuple(r) for r in gr.degrees(more).collect()}


def test_cascade_reads_edges_twice(spark, city):
    path = fresh_path(spark, "edges")
    city[1].write.parquet(path)
    read = spark.read.parquet(path)
    stored = materialize(gr.degrees(read), "degrees")
    seen = []

    class Counted:
        """A frame that tells how often it is read."""
        def select(self, *columns):
            seen.append(columns)
            return read.select(*columns)

    cut = spark.createDataFrame([("b1", "a")], "src string, dst string")
    n, e, left = gr.cascade_delete(city[0], Counted(), cut, stored)
    assert len(seen) == 2 and path not in str(e._jdf.queryExecution().optimizedPlan()) and e.count() == 2 and left.count() == 4


def test_registration_merges_the_whole_chain(spark, city):
    nodes, edges = city
    rows = [("S4", "DustSensor", "Two", "Main", "Town", "X"), ("N1", "Unheard", "New", "Main", "Town", "X"), ("N2", None, "Two", None, "Town", "X"),
            ("N3", "TemperatureSensor", None, "Main", "Town", "X"), (None, "Unheard", "Two", "Main", "Town", "X"), ("N1", "Unheard", "New", "Main", "Town", "X")]
    registrations = spark.createDataFrame(rows, "sensor_id string, sensor_type string, building string, street string, city string, country string")
    classes = spark.createDataFrame([("DustSensor", "AirSensor"), ("AirSensor", "Sensor"), ("TemperatureSensor", "Sensor"), ("Sensor", "DustSensor"),
                                     ("Unheard", "Building")], "name string, parent string")
    n, e, unknown = gr.register_sensors(nodes, edges, registrations, classes)
    assert {(r.sensor_id, r.sensor_type) for r in unknown.collect()} == {("N1", "Unheard")}
    found = {(r.label, r.props.get("sensorId") or r.props.get("name") or r.props["street"]): r for r in n.collect()}
    # the address of before has no country, so it is another one
    assert n.count() == nodes.count() + 5 and set(found[("Sensor", "S4")].labels) == {"Sensor", "TemperatureSensor", "DustSensor"}
    assert found[("Building", "Two")].id == "b2" and found[("SmartCity", "Town")].id == "c"
    new = {tuple(r) for r in e.collect()} - {tuple(r) for r in edges.collect()}
    assert ("s4", "locatedIn", "b2") in new and (found[("Sensor", "N2")].id, "locatedIn", "b2") in new and len(new) == 6
    again, links, _ = gr.register_sensors(n, e, registrations, classes)
    assert {r.id for r in again.collect()} == {r.id for r in n.collect()} and links.count() == e.count()


def test_linking_and_upsert_are_idempotent(spark, city):
    nodes, edges = city
    new = spark.createDataFrame([("s4", "locatedIn", "b2"), ("s4", "locatedIn", "nowhere")], "src string, rel string, dst string")
    once = gr.link(nodes, edges, new)
    assert once.count() == 8 and gr.link(nodes, once, new).count() == 8
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, x double")
    source = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, name string, x double")
    once = gr.upsert(target, source, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    assert sorted(map(tuple, gr.upsert(once, source, "k").collect())) == sorted(map(tuple, once.collect()))


# ---------------------------------------------------------------- ontology and profiles

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#"
         xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
  <owl:Class rdf:about="http://x.org/t#Sensor"><rdfs:label>A sensor</rdfs:label></owl:Class>
  <owl:Class rdf:about="http://x.org/t#Heat"><rdfs:subClassOf rdf:resource="http://x.org/t#Sensor"/></owl:Class>
  <owl:Class rdf:about="http://x.org/t#DryHeat"><rdfs:subClassOf rdf:resource="http://x.org/t#Heat"/></owl:Class>
  <owl:ObjectProperty rdf:about="http://x.org/t#locatedIn"><rdfs:domain rdf:resource="http://x.org/t#Sensor"/></owl:ObjectProperty>
  <owl:DatatypeProperty rdf:about="http://x.org/t#temperature"><rdfs:domain rdf:resource="http://x.org/t#Sensor"/>
    <rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#float"/></owl:DatatypeProperty>
</rdf:RDF>"""


def test_ontology(spark, tmp_path):
    path = tmp_path / "t.owl"
    path.write_text(OWL)
    classes, properties = read_classes(spark, str(path)), read_properties(spark, str(path))
    assert {(r.name, r.label, r.parent) for r in classes.collect()} == {
        ("Sensor", "A sensor", None), ("Heat", "Heat", "Sensor"), ("DryHeat", "DryHeat", "Heat")}
    assert {(r.name, r.domain, r.kind, r.value_type) for r in properties.collect()} == {
        ("locatedIn", "Sensor", "object", None), ("temperature", "Sensor", "data", "float")}
    types = spark.createDataFrame([("Sensor",), ("Heat",), ("DryHeat",), ("Boat",)], "type string")
    assert {r.type for r in valid_sensor_types(types, classes).collect()} == {"Sensor", "Heat"}
    fields = spark.createDataFrame([("Temp",), ("radiation",), ("timestamp",), ("wind_speed",)], "field string")
    rules = rules_frame(spark, [{"raw_key": "temp", "canonical_key": "temperature"}])
    alerts = unrecognized_fields(fields, rules, canonical_fields(properties)).collect()
    assert [r.id for r in alerts] == ["ontology-unknown-radiation", "ontology-unknown-wind_speed"]


def test_field_profile_and_schema(spark):
    rows = [("s", "t", i, f'{{"a": {i % 3}, "b": "x{i}", "c": {"true" if i else "null"}}}') for i in range(40)] + [("r", "t", 0, '{"a": "n/a"}')]
    profile = field_profile(spark.createDataFrame(rows, "ingestion_id string, topic string, ts int, value string"))
    got = {(r.ingestion_id, r.field): r for r in profile.collect()}
    assert got["s", "a"].samples == ["0", "1", "2"] and got["s", "b"].samples == ["x0", "x1", "x2", "x3", "x4"]
    assert got["s", "c"].type == "boolean" and got["s", "c"].nulls == 1
    schema = merged_schema(profile)
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [
        ("a", "string"), ("b", "string"), ("c", "boolean"), ("ingestion_id", "string")]
