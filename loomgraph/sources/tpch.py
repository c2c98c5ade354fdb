"""A property graph bound onto star-schema tables.

Properties stay columns of their tables, so that conditions on them reach the
Parquet scan, and a selector that asks for one kind of node reads one table:
the others are unions whose literal types Catalyst folds away.

Ids are ``k * 10**12 + key``; a shipment link is ``10**13 + order * 10**6 +
supplier``, good for keys of suppliers under a million.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from .feeds import Source

UNIT = 10**12
NODE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}
PORT = {"supplier": 7, "order": 8, "part": 9}
LINK = 10**13
LINK_STEP = 10**6
BOUND = {
    "acctbal": "DOUBLE",
    "segment": "TEXT",
    "brand": "TEXT",
    "size": "LONG",
    "price": "DOUBLE",
    "status": "TEXT",
    "total": "DOUBLE",
    "priority": "TEXT",
    "quantity": "DOUBLE",
    "revenue": "DOUBLE",
    "lines": "LONG",
}
FIXED = {
    "name": "string", "external_id": "string", "axis": "string", "node_id": "long", "from_id": "long", "to_id": "long", "derived": "boolean",
    "address": "array<string>", "role": "string", "domain": "string", "links": "long", "from_node": "long", "to_node": "long",
}
SQL = {"DOUBLE": "double", "TEXT": "string", "LONG": "long"}


_tables: dict[tuple[str, str, str], DataFrame] = {}
_graphs: dict[tuple[str, str], Graph] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Its schema is read once in an application, not its rows."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _tables[key]


def node_id(kind: str, key) -> F.Column:
    return (F.lit(NODE[kind] * UNIT) + key.cast("long")).alias("object_id")


def _objects(table: DataFrame, kind: str, type: str, object_id, **columns) -> DataFrame:
    cast = FIXED | {k: SQL[t] for k, t in BOUND.items()}
    return table.select(
        object_id.alias("object_id"), F.lit(kind).alias("kind"), F.lit(type).alias("type"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in cast.items()]
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order and supplier together: o, s, quantity, revenue, lines."""
    lines = table(spark, sf_dir, "lineitem")
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount")).cast("decimal(5,2)")
    return lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(money).cast("double").alias("revenue"), F.count(F.lit(1)).alias("lines")
    )


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers provide the parts they sell in their region, parts and orders require theirs."""
    read = lambda t: table(spark, sf_dir, t)
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("r_name")).alias("domain"))
    customers = read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("domain"))
    orders = read("orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "domain")
    address = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")).alias("address")
    port = lambda kind, c: (F.lit(PORT[kind] * UNIT) + F.col(c)).alias("port_id")
    sold = lines.select("l_suppkey", "l_partkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    need = lines.select("l_orderkey", "l_partkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [
        sold.select(port("supplier", "l_suppkey"), F.lit("OUTPUT").alias("kind"), F.lit("supply").alias("type"), F.lit("provide").alias("role"), "domain", address("l_partkey")),
        need.select(port("order", "l_orderkey"), F.lit("INPUT").alias("kind"), F.lit("demand").alias("type"), F.lit("require").alias("role"), "domain", address("l_partkey")),
        read("part").select(port("part", "p_partkey"), F.lit("INPUT").alias("kind"), F.lit("stock").alias("type"), F.lit("require").alias("role"), F.lit("").alias("domain"), address("p_partkey")),
    ]
    return reduce(DataFrame.unionAll, parts)


def bind(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables of a folder; only plans are kept between calls, no rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = _bind(spark, sf_dir)
    return _graphs[key]


def _bind(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda t: table(spark, sf_dir, t)
    region, nation, customer, supplier, part, orders = (read(t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    ext = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    ship = shipments(spark, sf_dir)
    out_port, in_port = F.lit(PORT["supplier"] * UNIT), F.lit(PORT["order"] * UNIT)
    # What makes the objects of each kind: first part of their ids, table, key, external ids, and the projection.
    makers = [
        (NODE["region"], region, "r_regionkey", "region:", lambda t: _objects(t, "NODE", "region", node_id("region", F.col("r_regionkey")), name=F.col("r_name"), external_id=ext("region", "r_regionkey"), axis=F.lit("placement"))),
        (NODE["nation"], nation, "n_nationkey", "nation:", lambda t: _objects(t, "NODE", "nation", node_id("nation", F.col("n_nationkey")), name=F.col("n_name"), external_id=ext("nation", "n_nationkey"), axis=F.lit("placement"))),
        (NODE["customer"], customer, "c_custkey", "customer:", lambda t: _objects(t, "NODE", "customer", node_id("customer", F.col("c_custkey")), name=F.col("c_name"), external_id=ext("customer", "c_custkey"), acctbal=F.col("c_acctbal"), segment=F.col("c_mktsegment"))),
        (NODE["supplier"], supplier, "s_suppkey", "supplier:", lambda t: _objects(t, "NODE", "supplier", node_id("supplier", F.col("s_suppkey")), name=F.col("s_name"), external_id=ext("supplier", "s_suppkey"), acctbal=F.col("s_acctbal"))),
        (NODE["part"], part, "p_partkey", "part:", lambda t: _objects(t, "NODE", "part", node_id("part", F.col("p_partkey")), name=F.col("p_name"), external_id=ext("part", "p_partkey"), brand=F.col("p_brand"), size=F.col("p_size"), price=F.col("p_retailprice"))),
        (NODE["order"], orders, "o_orderkey", "order:", lambda t: _objects(t, "NODE", "order", node_id("order", F.col("o_orderkey")), name=ext("order", "o_orderkey"), external_id=ext("order", "o_orderkey"), status=F.col("o_orderstatus"), total=F.col("o_totalprice"), priority=F.col("o_orderpriority"))),
        (PORT["supplier"], supplier, "s_suppkey", "supplier:>out", lambda t: _objects(t, "OUTPUT", "supply", out_port + F.col("s_suppkey"), name=F.lit("out"), external_id=F.concat(ext("supplier", "s_suppkey"), F.lit(">out")), node_id=node_id("supplier", F.col("s_suppkey")), role=F.lit("provide"))),
        (PORT["order"], orders, "o_orderkey", "order:<in", lambda t: _objects(t, "INPUT", "demand", in_port + F.col("o_orderkey"), name=F.lit("in"), external_id=F.concat(ext("order", "o_orderkey"), F.lit("<in")), node_id=node_id("order", F.col("o_orderkey")), role=F.lit("require"))),
        (PORT["part"], part, "p_partkey", "part:<in", lambda t: _objects(t, "INPUT", "stock", F.lit(PORT["part"] * UNIT) + F.col("p_partkey"), name=F.lit("in"), external_id=F.concat(ext("part", "p_partkey"), F.lit("<in")), node_id=node_id("part", F.col("p_partkey")), role=F.lit("require"))),
    ]
    shipped = lambda ship: _objects(
        ship, "LINK", "shipment", F.lit(LINK) + F.col("o") * LINK_STEP + F.col("s"), name=F.lit("shipment"), derived=F.lit(False),
        from_id=out_port + F.col("s"), to_id=in_port + F.col("o"), from_node=node_id("supplier", F.col("s")), to_node=node_id("order", F.col("o")),
        quantity=F.col("quantity"), revenue=F.col("revenue"), lines=F.col("lines"),
    )
    objects = [*(make(rows) for _, rows, _, _, make in makers), shipped(ship)]

    def lookup(wanted: int | str) -> DataFrame | None:
        """Objects of an id or external id by a filter on the key of their table, which reaches its scan."""
        if isinstance(wanted, int):
            if wanted >= LINK:
                order, supplier_key = divmod(wanted - LINK, LINK_STEP)
                return shipped(ship.where((F.col("o") == order) & (F.col("s") == supplier_key)))
            unit, key = divmod(wanted, UNIT)
            return next((make(rows.where(F.col(c) == key)) for k, rows, c, _, make in makers if k == unit), None)
        m = re.fullmatch(r"([a-z]+:)(\d+)(>out|<in)?", wanted)
        return m and next((make(rows.where(F.col(c) == int(m[2]))) for _, rows, c, form, make in makers if form == m[1] + (m[3] or "")), None)

    edge = lambda frame, axis, pk, pc, ck, cc: frame.select(F.lit(axis).alias("axis"), node_id(pk, F.col(pc)).alias("parent_id"), node_id(ck, F.col(cc)).alias("child_id"))
    places = [edge(nation, "placement", "region", "n_regionkey", "nation", "n_nationkey")]
    places += [edge(customer, "placement", "nation", "c_nationkey", "customer", "c_custkey").unionAll(edge(supplier, "placement", "nation", "s_nationkey", "supplier", "s_suppkey"))]
    owned = [edge(orders, "ownership", "customer", "o_custkey", "order", "o_orderkey")]
    return Graph(
        reduce(DataFrame.unionAll, objects),
        reduce(DataFrame.unionAll, [*places, *owned]),
        declared=declared(spark, sf_dir),
        bound=BOUND,
        levels={"placement": places, "ownership": owned},
        holders={"placement": objects[0].unionAll(objects[1]), "ownership": objects[2]},
        lookup=lookup,
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as words of two sources: observations of users, removals on errors of few users, a completion of every scope at each day's end."""
    events = table(spark, sf_dir, "events")
    # The clock as it is written, whatever the session's time zone.
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    source = (F.col("user_id") % 2).cast("int")
    day = F.to_date("ts")
    seen = events.select(
        source.alias("source_id"), (micros * 8).alias("seq"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), "REMOVED").otherwise("OBSERVED").alias("word"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("external_id"), F.col("event_type").alias("version"), (F.col("user_id") % 4).cast("int").alias("scope"), F.col("props").alias("payload"),
    )
    ends = events.select(day.alias("day")).distinct()
    none = F.lit(None).cast("string")
    done = ends.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scope"), "day").select(
        (F.col("scope") % 2).cast("int").alias("source_id"), ((F.unix_date("day") + 1).cast("long") * 86_400_000_000 * 8 - 8 + F.col("scope")).alias("seq"), F.lit("COMPLETE").alias("word"), none.alias("external_id"), none.alias("version"), "scope", none.alias("payload"),
    )
    return seen.unionAll(done)


class Events(Source):
    """The words of one of the two sources of ``words``, but for completions, read from the events as they lie; offsets are row numbers."""

    def __init__(self, source_id: int, path: str) -> None:
        self.source_id, self.path = source_id, path

    def _groups(self):
        """Row groups with the numbers of their first and last + 1 rows."""
        at = 0
        for fragment in dataset.dataset(self.path, format="parquet").get_fragments():
            for group in fragment.split_by_row_group():
                n = group.count_rows()
                yield group, at, at + n
                at += n

    def latest(self) -> int:
        return max((end for _, _, end in self._groups()), default=0)

    def pieces(self, start: int, end: int):
        return [(max(a, start), min(b, end)) for _, a, b in self._groups() if a < end and b > start]

    def words(self, start: int, end: int):
        for group, a, b in self._groups():
            if a >= end or b <= start:
                continue
            rows = group.to_table(columns=["ts", "user_id", "event_type", "props"], use_threads=False).slice(max(a, start) - a, min(b, end) - max(a, start))
            rows = rows.filter(pc.equal(pc.bit_wise_and(rows["user_id"], 1), self.source_id))
            user, kind = rows["user_id"], rows["event_type"]
            fifth = pc.equal(pc.subtract(user, pc.multiply(pc.divide(user, 5), 5)), 0)
            gone = pc.and_(pc.equal(kind, "error"), fifth)
            yield from pa.table(
                {
                    "seq": pc.multiply(rows["ts"].cast(pa.timestamp("us")).cast(pa.int64()), 8),
                    "word": pc.if_else(pc.fill_null(gone, False), "REMOVED", "OBSERVED"),
                    "external_id": pc.binary_join_element_wise("user", user.cast(pa.string()), ":"),
                    "version": kind,
                    "scope": pc.bit_wise_and(user, 3),
                    "payload": rows["props"],
                }
            ).to_batches()

    def rejected(self, observation: dict | None, reason: str) -> None:
        raise ValueError(f"{observation}: {reason}")
