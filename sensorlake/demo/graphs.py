"""Graph of regions (cities), nations (addresses), customers (buildings), orders (sensors)."""

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import preview as pv
from . import views as v
from .registry import query


def _id(prefix, key):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark, sf):
    def part(table, prefix, key, label, kinds, **props):
        pairs = [x for name, c in props.items() for x in (F.lit(name), c)]
        return v.table(spark, sf, table).select(
            _id(prefix, key).alias("id"), F.lit(label).alias("label"), F.array(F.lit(label), *kinds).alias("labels"),
            F.create_map(*pairs).alias("props"))
    return (part("region", "r", "r_regionkey", gr.CITY, [], name=F.col("r_name"))
            .unionByName(part("nation", "n", "n_nationkey", gr.ADDRESS, [], street=F.col("n_name"),
                              city=_id("city ", "n_regionkey"), country=F.lit("TPC")))
            .unionByName(part("customer", "c", "c_custkey", gr.BUILDING, [], name=F.col("c_name"),
                              lat=F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") / 200).cast("string")),
                              lng=F.col("c_nationkey").cast("string")))
            .unionByName(part("orders", "o", "o_orderkey", gr.SENSOR, [F.col("o_orderpriority")],
                              sensorId=_id("o", "o_orderkey"))))


def edges(spark, sf):
    """Only urgent orders are installed in a building; the others have no place yet."""
    urgent = v.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    customer, nation = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    return (urgent.select(_id("o", "o_orderkey").alias("src"), F.lit(gr.LOCATED_IN).alias("rel"), _id("c", "o_custkey").alias("dst"))
            .unionByName(customer.select(_id("c", "c_custkey").alias("src"), F.lit(gr.HAS_ADDRESS).alias("rel"), _id("n", "c_nationkey").alias("dst")))
            .unionByName(nation.select(_id("n", "n_nationkey").alias("src"), F.lit(gr.LOCATED_IN).alias("rel"), _id("r", "n_regionkey").alias("dst"))))


def _graph(spark, sf):
    return nodes(spark, sf), edges(spark, sf)


_EDGES = """edges AS (SELECT 'o' || o_orderkey AS src, 'locatedIn' AS rel, 'c' || o_custkey AS dst FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'c' || c_custkey, 'hasAddress', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'locatedIn', 'r' || n_regionkey FROM nation)"""
_PLACES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("graph_sensor_context", f"""SELECT 'o' || o_orderkey AS sensor, o_orderpriority AS sensor_type, c_name AS building, n_name AS street,
    'city ' || n_regionkey AS city, CASE WHEN n_name IS NOT NULL THEN 'TPC' END AS country, r_name AS smart_city
  FROM orders LEFT JOIN ({_PLACES}) ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    return gr.sensor_context(*_graph(spark, sf))


@query("graph_sensors_in_building", """SELECT 'o' || o_orderkey AS sensor, c_name AS building FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    return gr.sensors_in_building(*_graph(spark, sf))


@query("graph_full_chain", f"""SELECT 'o' || o_orderkey AS sensor, c_name AS building, n_name AS street, 'city ' || n_regionkey AS city, r_name AS smart_city
  FROM orders JOIN ({_PLACES}) ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    return gr.full_chain(*_graph(spark, sf))


@query("graph_city_overview", f"""SELECT r_name AS city, c_name AS building, CAST(0 AS BIGINT) AS part, string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey) AS sensors
  FROM orders JOIN ({_PLACES}) ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def _(spark, sf):
    return gr.city_overview(*_graph(spark, sf)).withColumn("sensors", F.array_join("sensors", ","))


@query("graph_buildings_without_sensors", """SELECT c_name AS building FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    return gr.buildings_without_sensors(*_graph(spark, sf))


@query("graph_all_sensors", "SELECT 'o' || o_orderkey AS sensor, 'Sensor,' || o_orderpriority AS labels FROM orders")
def _(spark, sf):
    return gr.all_sensors(nodes(spark, sf)).withColumn("labels", F.array_join("labels", ","))


@query("graph_all_buildings", f"SELECT c_name AS building, n_name AS street, 'city ' || n_regionkey AS city, 'TPC' AS country FROM {_PLACES}")
def _(spark, sf):
    return gr.all_buildings(*_graph(spark, sf))


@query("graph_building_positions", """SELECT c_name AS building, c_acctbal / 200 AS lat, CAST(c_nationkey AS DOUBLE) AS lng FROM customer WHERE c_acctbal > 0""")
def _(spark, sf):
    return gr.building_positions(nodes(spark, sf))


@query("graph_rel_counts", f"WITH {_EDGES} SELECT rel, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1")
def _(spark, sf):
    return gr.relation_counts(edges(spark, sf))


@query("graph_label_counts", """SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['Sensor', o_orderpriority]) AS label FROM orders
  UNION ALL SELECT 'Building' FROM customer UNION ALL SELECT 'Address' FROM nation UNION ALL SELECT 'SmartCity' FROM region) GROUP BY 1""")
def _(spark, sf):
    return gr.label_counts(nodes(spark, sf))


@query("graph_all_edges", f"WITH {_EDGES} SELECT DISTINCT src, rel, dst FROM edges")
def _(spark, sf):
    found = edges(spark, sf)
    return gr.whole_graph(nodes(spark, sf), found.unionByName(found))[1]


@query("graph_all_nodes", """SELECT 'o' || o_orderkey AS id, 'Sensor' AS label FROM orders UNION ALL SELECT 'c' || c_custkey, 'Building' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'Address' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'SmartCity' FROM region""")
def _(spark, sf):
    found = nodes(spark, sf)
    return gr.whole_graph(found.unionByName(found), edges(spark, sf))[0].select("id", "label")


@query("graph_link", f"""WITH {_EDGES} SELECT src, rel, dst FROM edges
  UNION SELECT 'r' || n_regionkey, 'hasSensor', 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    found, links = _graph(spark, sf)
    orders, customer, nation = (v.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    new = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(_id("r", "n_regionkey").alias("src"), F.lit(gr.HAS_SENSOR).alias("rel"), _id("o", "o_orderkey").alias("dst"))
    dangling = orders.select(F.lit("r99").alias("src"), F.lit(gr.HAS_SENSOR).alias("rel"), _id("o", "o_orderkey").alias("dst"))
    once = gr.link(found, links, new.unionByName(dangling))
    return gr.link(found, once, new)


@query("graph_delete_cascade", f"""WITH {_EDGES}, gone AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4) OR c_acctbal < 0)
  SELECT src, rel, dst FROM edges WHERE NOT (rel = 'hasAddress' AND src IN (SELECT 'c' || c_custkey FROM gone))
    AND dst NOT IN (SELECT 'c' || c_custkey FROM gone) AND src NOT IN ('n3', 'n4')""")
def _(spark, sf):
    found, links = _graph(spark, sf)
    cut = v.table(spark, sf, "customer").where("c_nationkey in (3, 4) or c_acctbal < 0").select(
        _id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"))
    return gr.delete_address_links(found, links, cut)[1]


_PLACED = """r AS (
    SELECT 'o' || o_orderkey AS sensor_id, o_orderpriority AS sensor_type, c_name AS building, n_name AS street, 'city ' || n_regionkey AS city, 'TPC' AS country
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 's' || s_suppkey, NULL, CASE WHEN s_acctbal > 0 THEN s_name END, s_name, 'city ' || s_nationkey, CASE WHEN s_nationkey > 5 THEN 'TPC' END FROM supplier),
  whole AS (SELECT * FROM r WHERE building IS NOT NULL AND street IS NOT NULL AND city IS NOT NULL AND country IS NOT NULL)"""


def _registrations(spark, sf):
    """Every order as a sensor of its customer's building, and a new sensor for each supplier, some without a whole place."""
    orders, customer, nation, supplier = (v.table(spark, sf, t) for t in ("orders", "customer", "nation", "supplier"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    known = placed.select(_id("o", "o_orderkey").alias("sensor_id"), F.col("o_orderpriority").alias("sensor_type"), F.col("c_name").alias("building"),
                          F.col("n_name").alias("street"), _id("city ", "n_regionkey").alias("city"), F.lit("TPC").alias("country"))
    return known.unionByName(supplier.select(
        _id("s", "s_suppkey").alias("sensor_id"), F.lit(None).cast("string").alias("sensor_type"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("building"),
        F.col("s_name").alias("street"), _id("city ", "s_nationkey").alias("city"), F.when(F.col("s_nationkey") > 5, "TPC").alias("country")))


@query("graph_register", f"""WITH {_EDGES}, {_PLACED}, named AS (
    SELECT 'o' || o_orderkey AS id, 'o' || o_orderkey AS name FROM orders UNION ALL SELECT 'c' || c_custkey, c_name FROM customer
    UNION ALL SELECT 'n' || n_nationkey, n_name || '|city ' || n_regionkey || '|TPC' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region)
  SELECT s.name AS src, rel, d.name AS dst FROM edges e JOIN named s ON s.id = e.src JOIN named d ON d.id = e.dst
  UNION SELECT sensor_id, 'locatedIn', building FROM r WHERE building IS NOT NULL
  UNION SELECT building, 'hasAddress', street || '|' || city || '|' || country FROM whole
  UNION SELECT street || '|' || city || '|' || country, 'locatedIn', city FROM whole""")
def _(spark, sf):
    # the same registrations twice: the second time changes nothing
    found, links = _graph(spark, sf)
    for _ in range(2):
        found, links, _unknown = gr.register_sensors(found, links, _registrations(spark, sf))
    name = F.when(F.col("label") == gr.ADDRESS, F.concat_ws("|", F.col("props")["street"], F.col("props")["city"], F.col("props")["country"])) \
        .otherwise(F.coalesce(F.col("props")["sensorId"], F.col("props")["name"]))
    named = found.select("id", name.alias("name"))
    return links.join(named.select(F.col("id").alias("src"), F.col("name").alias("from")), "src") \
        .join(named.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst") \
        .select(F.col("from").alias("src"), "rel", F.col("to").alias("dst"))


@query("graph_unknown_types", """WITH RECURSIVE classes AS (
    SELECT DISTINCT p_type AS name, 'Sensor' AS parent FROM part WHERE p_type <> 'LARGE'
    UNION SELECT DISTINCT p_type || ' ' || p_size, p_type FROM part UNION SELECT DISTINCT p_type || ' ' || p_size || ' ' || p_brand, p_type || ' ' || p_size FROM part),
  below(name) AS (SELECT 'Sensor' UNION SELECT c.name FROM classes c JOIN below b ON c.parent = b.name)
  SELECT 'p' || p_partkey AS sensor_id, p_type || ' ' || p_size || ' ' || p_brand AS sensor_type FROM part
  WHERE p_type || ' ' || p_size || ' ' || p_brand NOT IN (SELECT name FROM below)""")
def _(spark, sf):
    # three levels: types are sensor classes but for one, types by size are below types, brands of a size below those
    part = v.table(spark, sf, "part")
    sized, branded = F.concat_ws(" ", "p_type", "p_size"), F.concat_ws(" ", "p_type", "p_size", "p_brand")
    classes = part.where("p_type <> 'LARGE'").select(F.col("p_type").alias("name"), F.lit(gr.SENSOR).alias("parent")) \
        .unionByName(part.select(sized.alias("name"), F.col("p_type").alias("parent"))) \
        .unionByName(part.select(branded.alias("name"), sized.alias("parent")))
    none = F.lit(None).cast("string")
    registrations = part.select(_id("p", "p_partkey").alias("sensor_id"), branded.alias("sensor_type"),
                                *[none.alias(c) for c in ("building", "street", "city", "country")])
    return gr.register_sensors(*_graph(spark, sf), registrations, classes)[2].select("sensor_id", "sensor_type")


@query("graph_degrees_after_cascade", f"""WITH {_EDGES}, gone AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4) OR c_acctbal < 0),
  kept AS (SELECT * FROM edges WHERE NOT (rel = 'hasAddress' AND src IN (SELECT 'c' || c_custkey FROM gone))
    AND dst NOT IN (SELECT 'c' || c_custkey FROM gone) AND src NOT IN ('n3', 'n4'))
  SELECT id, rel, CAST(count(*) AS BIGINT) AS n FROM (SELECT src AS id, rel FROM kept UNION ALL SELECT dst, rel FROM kept) GROUP BY 1, 2""")
def _(spark, sf):
    found, links = _graph(spark, sf)
    cut = v.table(spark, sf, "customer").where("c_nationkey in (3, 4) or c_acctbal < 0").select(
        _id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"))
    return gr.cascade_delete(found, links, cut, gr.degrees(links))[2]


@query("graph_detach_delete", f"""WITH {_EDGES} SELECT id FROM (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'MACHINERY'
    UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)
  WHERE id NOT IN (SELECT src FROM edges)
    OR id IN (SELECT src FROM edges WHERE dst NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))""")
def _(spark, sf):
    gone = v.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(_id("c", "c_custkey").alias("id"))
    kept, links = gr.detach_delete(*_graph(spark, sf), gone)
    # nodes that never had a way out, or still have one
    lost = edges(spark, sf).select(F.col("src").alias("id")).distinct().join(links.select(F.col("src").alias("id")), "id", "left_anti")
    return kept.select("id").join(lost, "id", "left_anti")


@query("upsert", """SELECT c_custkey, c_name, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END AS c_nationkey,
    CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer LEFT JOIN supplier ON s_suppkey * 2 = c_custkey
  UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def _(spark, sf):
    supplier = v.table(spark, sf, "supplier")
    changed = supplier.select((F.col("s_suppkey") * 2).alias("c_custkey"), F.lit(None).cast("string").alias("c_name"),
                              F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    added = supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"),
                            F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return gr.upsert(v.table(spark, sf, "customer"), changed.unionByName(added), "c_custkey")


@query("dependents", """SELECT p_partkey AS id, p_name AS name, CAST(count(l_partkey) AS BIGINT) AS tiles, count(l_partkey) > 0 AS has_dependencies
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY ALL""")
def _(spark, sf):
    tiles = v.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("computation_id"))
    parts = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return gr.dependents(parts, tiles)


# ---------------------------------------------------------------- what-if previews

_CUSTOM = [{"raw_key": "TEMP", "canonical_key": "celsius"}, {"raw_key": "hum", "canonical_key": "humidity"}]


@query("preview_rules", f"""WITH {v.BRONZE}, {v.RULES_SQL}, cols(c) AS (VALUES ('ingestion_id'), ('timestamp'), ('sensor_id'), ('Temp'), ('HUMIDITY'), ('source_type')),
  r AS (SELECT CAST(id AS VARCHAR) AS rule_id, 'existing' AS type, raw_key, canonical_key FROM rules WHERE enabled
    UNION ALL VALUES ('custom_0', 'custom', 'temp', 'celsius'), ('custom_1', 'custom', 'hum', 'humidity')),
  n AS (SELECT count(*) AS readings FROM ev)
  SELECT c AS "column", rule_id, type, raw_key, canonical_key, CAST(readings AS BIGINT) AS readings FROM cols CROSS JOIN n LEFT JOIN r ON contains(lower(c), raw_key)""")
def _(spark, sf):
    df = v.bronze(spark, sf).drop("event_id")
    hits = pv.preview_rules(df, v.rules(spark), _CUSTOM, mode="contains")
    # how many readings each column would bring along
    counts = df.select(*[F.count(f"`{c}`").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "readings")
    return hits.join(counts, "column")


@query("compare_scenarios", f"""WITH {v.BRONZE}, n AS (SELECT count(temp) AS readings FROM ev), t(c, a, b) AS (VALUES ('ingestion_id', '', ''), ('timestamp', '', ''), ('sensor_id', 'sensorId', 'sensorId'),
    ('Temp', 'celsius,error_level,temperature', 'error_level,temperature'), ('HUMIDITY', 'humidity', 'humidity'), ('source_type', '', 'origin'))
  SELECT c AS "column", a AS scenario_a, b AS scenario_b, a = b AS same, CAST(readings AS BIGINT) AS readings FROM t, n""")
def _(spark, sf):
    df = v.bronze(spark, sf).drop("event_id")
    out = pv.compare_scenarios(df, v.rules(spark), _CUSTOM, [{"raw_key": "source_type", "canonical_key": "origin"}])
    counts = df.select(*[F.count(f"`{c}`").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "readings")
    return out.join(counts, "column")


@query("check_rules", f"""WITH {v.BRONZE}, names AS (SELECT 'src_' || event_type AS raw, 10 + min(event_id) AS id FROM events GROUP BY 1), r AS (
    SELECT 1 AS id, 'temp' AS raw_key, 'temperature' AS canonical_key UNION ALL SELECT 2, 'pressure', 'temperature' UNION ALL SELECT 3, 'humidity', ' '
    UNION ALL SELECT id, raw, raw FROM names)
  SELECT CAST(id AS BIGINT) AS id, raw_key, canonical_key, raw_key IN ('temp', 'humidity') AS raw_key_found, trim(canonical_key) <> '' AS has_name,
    canonical_key = 'temperature' AS name_shared, raw_key = 'temp' AS valid FROM r""")
def _(spark, sf):
    df = v.bronze(spark, sf)
    fixed = spark.createDataFrame([(1, "Temp", "temperature"), (2, "pressure", "temperature"), (3, "humidity", " ")],
                                  "id long, raw_key string, canonical_key string")
    # and a mistaken rule per source: somebody entered source ids as raw keys
    wrong = df.groupBy(F.col("ingestion_id").alias("raw_key")).agg((F.min("event_id") + 10).alias("id")) \
        .select("id", "raw_key", F.col("raw_key").alias("canonical_key"))
    return pv.check_rules(fixed.unionByName(wrong), df)
