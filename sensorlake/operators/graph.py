"""Locations of sensors as a property graph in two frames.

Nodes are ``(id, label, labels, props)``, edges ``(src, rel, dst)``. Sensors are located in
buildings, buildings have an address, addresses are located in a city. Traversals join the short
end first (building to city), so that the many sensors take part in one join only.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

# Labels and relations.
SENSOR, BUILDING, ADDRESS, CITY = "Sensor", "Building", "Address", "SmartCity"
LOCATED_IN, HAS_ADDRESS, HAS_SENSOR = "locatedIn", "hasAddress", "hasSensor"


def _of(nodes: DataFrame, label: str, prefix: str, **props: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select(
        F.col("id").alias(prefix), *[F.col("props")[key].alias(name) for name, key in props.items()])


def _linked(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst))


def building_locations(nodes: DataFrame, edges: DataFrame, how: str = "left") -> DataFrame:
    """Building, street, city, country and smart city: ``how`` 'left' keeps incomplete chains."""
    building = _of(nodes, BUILDING, "_building", building="name")
    address = _of(nodes, ADDRESS, "_address", street="street", city="city", country="country")
    city = _of(nodes, CITY, "_city", smart_city="name")
    # an edge counts only if it ends in a node of the right label
    in_city = _linked(edges, LOCATED_IN, "_address", "_city").join(city, "_city").select("_address", "smart_city")
    places = address.join(in_city, "_address", how)
    at = _linked(edges, HAS_ADDRESS, "_building", "_address").join(places, "_address")
    return building.join(at, "_building", how).drop("_address")


def _sensor_buildings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    buildings = _of(nodes, BUILDING, "_building")
    return _linked(edges, LOCATED_IN, "_sensor", "_building").join(buildings, "_building", "left_semi")


def sensor_context(nodes: DataFrame, edges: DataFrame, sensors: DataFrame | None = None) -> DataFrame:
    """Every sensor with whatever of its location is known; ``sensors`` (``sensor``) restricts."""
    found = nodes.where(F.col("label") == SENSOR).select(
        F.col("id").alias("_sensor"), F.col("props")["sensorId"].alias("sensor"),
        F.coalesce(F.get(F.filter("labels", lambda x: x != SENSOR), 0), F.lit(SENSOR)).alias("sensor_type"))
    if sensors is not None:
        found = found.join(sensors, "sensor", "left_semi")
    placed = _sensor_buildings(nodes, edges).join(building_locations(nodes, edges), "_building")
    return found.join(placed, "_sensor", "left").drop("_sensor", "_building")


def full_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sensors whose location is known up to the smart city."""
    return (_of(nodes, SENSOR, "_sensor", sensor="sensorId")
            .join(_sensor_buildings(nodes, edges), "_sensor")
            .join(building_locations(nodes, edges, "inner"), "_building")
            .select("sensor", "building", "street", "city", "smart_city"))


def sensors_in_building(nodes: DataFrame, edges: DataFrame, building: str | Column | None = None) -> DataFrame:
    """(sensor, building) pairs, of one building if named."""
    buildings = _of(nodes, BUILDING, "_building", building="name")
    if building is not None:
        buildings = buildings.where(F.col("building") == building)
    links = _linked(edges, LOCATED_IN, "_sensor", "_building")
    return (_of(nodes, SENSOR, "_sensor", sensor="sensorId").join(links.join(buildings, "_building"), "_sensor")
            .select("sensor", "building"))


def city_overview(nodes: DataFrame, edges: DataFrame, city: str | None = None,
                  list_size: int = 1000) -> DataFrame:
    """Each city's buildings with their sensors, as sorted lists.

    A building with more than ``list_size`` sensors gets several rows, numbered by ``part``: its
    sensors are spread by hash, so no list grows with the building.
    """
    chain = full_chain(nodes, edges).select(F.col("smart_city").alias("city"), "building", "sensor")
    if city is not None:
        chain = chain.where(F.col("city") == city)
    parts = chain.groupBy("city", "building").agg(
        F.ceil(F.count("*") / F.lit(list_size)).alias("_parts"))
    spread = chain.join(parts, ["city", "building"]).withColumn(
        "part", F.pmod(F.xxhash64("sensor"), F.col("_parts")))
    return spread.groupBy("city", "building", "part").agg(
        F.array_sort(F.collect_list("sensor")).alias("sensors"))


def buildings_without_sensors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    links = _linked(edges, LOCATED_IN, "_sensor", "_building").join(
        _of(nodes, SENSOR, "_sensor"), "_sensor", "left_semi")
    return _of(nodes, BUILDING, "_building", building="name").join(links, "_building", "left_anti") \
        .select("building")


def all_sensors(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label") == SENSOR).select(F.col("props")["sensorId"].alias("sensor"), "labels")


def all_buildings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every building, with its address if it has one."""
    return building_locations(nodes, edges).select("building", "street", "city", "country")


def building_positions(nodes: DataFrame) -> DataFrame:
    """Buildings with known coordinates."""
    return _of(nodes, BUILDING, "_building", building="name", lat="lat", lng="lng") \
        .where("lat is not null and lng is not null") \
        .select("building", F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def whole_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (by id) and edges (both ends present)."""
    unique = nodes.dropDuplicates(["id"])
    known = unique.select("id")
    both = edges.distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi") \
        .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return unique, both.select("src", "rel", "dst")


# ---------------------------------------------------------------- changes

def link(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with ``new`` ones added where both ends exist; adding twice changes nothing.

    Only the new edges are made distinct and looked up; those there stay as they are.
    """
    ids = nodes.select("id").distinct()
    valid = new.select("src", "rel", "dst").distinct() \
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi") \
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")
    there = edges.select("src", "rel", "dst")
    return there.unionByName(valid.join(there, ["src", "rel", "dst"], "left_anti"))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the nodes in ``gone`` (``id``) together with every edge that touches them."""
    kept_edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti") \
        .join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "rel", "dst")
    return nodes.join(gone.select("id"), "id", "left_anti"), kept_edges


def degrees(edges: DataFrame) -> DataFrame:
    """(id, rel, n): edges of each kind at a node, whichever way they point. A table to keep beside the edges."""
    ends = F.explode(F.array("src", "dst")).alias("id")
    return edges.select(ends, "rel").groupBy("id", "rel").agg(F.count("*").alias("n"))


def changed_degrees(stored: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Stored degrees after edges were added and removed; only the changed edges are read."""
    parts = [stored.select("id", "rel", "n")]
    parts += [degrees(added)] if added is not None else []
    parts += [degrees(removed).withColumn("n", -F.col("n"))] if removed is not None else []
    return reduce(DataFrame.unionByName, parts).groupBy("id", "rel").agg(F.sum("n").alias("n")).where("n > 0")


def cascade_delete(nodes: DataFrame, edges: DataFrame, links: DataFrame,
                   stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove building-address links (``src, dst``), then the buildings left without an address and the addresses left without
    a building, with their edges; returns nodes, edges and ``degrees`` after that.

    Who is left alone is read off the stored degrees: edges are read once for the links that exist, and once to mark
    what goes.
    """
    wanted = links.select("src", "dst", F.lit(HAS_ADDRESS).alias("rel")).distinct()
    cut = materialize(edges.select("src", "rel", "dst").join(wanted, ["src", "rel", "dst"], "left_semi"), "cut-links")
    lost = degrees(cut).select("id", "rel", F.col("n").alias("lost"))
    orphans = materialize(stored.join(lost, ["id", "rel"]).where("n <= lost").select("id"), "orphans")
    flag = F.lit(True).alias
    marked = (edges.select("src", "rel", "dst").join(cut.distinct().select("src", "rel", "dst", flag("_cut")), ["src", "rel", "dst"], "left")
              .join(orphans.select(F.col("id").alias("src"), flag("_from")), "src", "left")
              .join(orphans.select(F.col("id").alias("dst"), flag("_to")), "dst", "left")
              .select("src", "rel", "dst", F.coalesce("_cut", "_from", "_to", F.lit(False)).alias("_gone")))
    marked = materialize(marked, "marked-edges")
    kept, removed = (marked.where(c).select("src", "rel", "dst") for c in (~F.col("_gone"), F.col("_gone")))
    return nodes.join(orphans, "id", "left_anti"), kept, changed_degrees(stored, removed=removed)


def delete_address_links(nodes: DataFrame, edges: DataFrame,
                         links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cascade_delete`` for edges whose degrees nobody keeps; they are counted first."""
    kept_nodes, kept, _ = cascade_delete(nodes, edges, links, degrees(edges.where(F.col("rel") == HAS_ADDRESS)))
    return kept_nodes, kept


def subclasses(classes: DataFrame, root: str = SENSOR) -> DataFrame:
    """(name): ``root`` and every class (``name, parent``) below it, at any depth; circles are walked once."""
    return classes.sparkSession.sql("""
        WITH RECURSIVE below(name, path) AS (
          SELECT :root, array(:root)
          UNION ALL
          SELECT c.name, array_append(path, c.name) FROM {classes} c JOIN below b ON c.parent = b.name
          WHERE NOT array_contains(path, c.name))
        SELECT DISTINCT name FROM below""", args={"root": root}, classes=classes.select("name", "parent").distinct())


def _node_key(label: Column, props: Column) -> Column:
    """What makes two nodes of a label the same; null if the node lacks it."""
    address = F.when(props["street"].isNotNull() & props["city"].isNotNull() & props["country"].isNotNull(),
                     F.to_json(F.array(props["street"], props["city"], props["country"])))
    return F.when(label == SENSOR, props["sensorId"]).when(label == ADDRESS, address).otherwise(props["name"])


def register_sensors(nodes: DataFrame, edges: DataFrame, registrations: DataFrame,
                     classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sensors with their places: nodes, edges, and the registrations whose type is no subclass of Sensor.

    A registration (``sensor_id, sensor_type, building, street, city, country``) merges its sensor by id, its building by
    name, its address by street, city and country, and its smart city by the address's city, and links them in this order;
    without a building there are no links, without the whole address none beyond the building. A type becomes a label of
    the sensor, known or not. Registering twice changes nothing. All four kinds of nodes are one delta: made distinct
    where they are, merged by key in one join, and only new edges are looked up.
    """
    r = F.col
    whole = r("building").isNotNull() & r("street").isNotNull() & r("city").isNotNull() & r("country").isNotNull()

    def node(label: str, when: Column, **props: str) -> Column:
        pairs = F.create_map(*[x for name, c in props.items() for x in (F.lit(name), F.col(c).cast("string"))])
        kinds = F.array_compact(F.array(F.lit(label), r("sensor_type") if label == SENSOR else F.lit(None).cast("string")))
        return F.when(when, F.struct(F.lit(label).alias("label"), kinds.alias("labels"), pairs.alias("props"),
                                     _node_key(F.lit(label), pairs).alias("key")))

    chain = [node(SENSOR, r("sensor_id").isNotNull(), sensorId="sensor_id"),
             node(BUILDING, r("sensor_id").isNotNull() & r("building").isNotNull(), name="building"),
             node(ADDRESS, r("sensor_id").isNotNull() & whole, street="street", city="city", country="country"),
             node(CITY, r("sensor_id").isNotNull() & whole, name="city")]
    chained = registrations.select(F.array(*chain).alias("chain"))
    delta = (chained.select(F.explode(F.array_compact("chain")).alias("n")).select("n.*").groupBy("label", "key")
             .agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("more"), F.any_value("props").alias("new_props")))
    keyed = nodes.withColumn("key", _node_key(F.col("label"), F.col("props")))
    merged = keyed.join(delta, ["label", "key"], "full_outer")
    made = F.concat_ws(":", F.lower("label"), F.sha2("key", 256))
    merged = materialize(merged.select(
        F.coalesce("id", made).alias("id"), "label", F.array_distinct(F.concat(F.coalesce("labels", F.array()), F.coalesce("more", F.array()))).alias("labels"),
        F.coalesce("props", "new_props").alias("props"), "key", F.col("more").isNotNull().alias("_met")), "merged-nodes")

    ids = merged.where("_met").groupBy("label", "key").agg(F.min("id").alias("id"))
    hops = F.array(*[F.when(F.col("chain")[i + 1].isNotNull(), F.struct(F.col("chain")[i].alias("a"), F.lit(rel).alias("rel"), F.col("chain")[i + 1].alias("b")))
                     for i, rel in enumerate((LOCATED_IN, HAS_ADDRESS, LOCATED_IN))])
    hops = chained.select(F.explode(F.array_compact(hops)).alias("h")).select(
        F.col("h.a.label").alias("a_label"), F.col("h.a.key").alias("a_key"), "h.rel", F.col("h.b.label").alias("b_label"), F.col("h.b.key").alias("b_key")).distinct()
    ends = [ids.select(F.col("label").alias(f"{x}_label"), F.col("key").alias(f"{x}_key"), F.col("id").alias(end)) for x, end in (("a", "src"), ("b", "dst"))]
    new = hops.join(ends[0], ["a_label", "a_key"]).join(ends[1], ["b_label", "b_key"]).select("src", "rel", "dst")
    there = edges.select("src", "rel", "dst")
    linked = there.unionByName(new.join(there, ["src", "rel", "dst"], "left_anti"))
    typed = registrations.where("sensor_type is not null and sensor_id is not null")
    unknown = typed.limit(0) if classes is None else typed.join(subclasses(classes), F.col("sensor_type") == F.col("name"), "left_anti")
    return merged.select(*nodes.columns), linked, unknown


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows updated by, and extended with, the source's; the source's nulls change nothing.

    ``source`` has one row per key; columns it lacks keep the target's value.
    """
    incoming = source.select(F.lit(True).alias("_in"), *[F.col(f"`{c}`").alias(f"new:{c}") for c in source.columns])
    joined = target.join(incoming, F.col(f"`{key}`") == F.col(f"`new:{key}`"), "full_outer")
    return joined.select(*[
        (F.coalesce(F.col(f"`new:{c}`"), F.col(f"`{c}`")) if c in source.columns else F.col(f"`{c}`")).alias(c)
        for c in target.columns])


def dependents(computations: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per computation (``id``): how many tiles (``computation_id``) use it."""
    used = tiles.groupBy(F.col("computation_id").alias("id")).agg(F.count("*").alias("_n"))
    return computations.join(used, "id", "left").withColumn("tiles", F.coalesce("_n", F.lit(0))) \
        .withColumn("has_dependencies", F.col("tiles") > 0).drop("_n")
