"""A live property graph as DataFrames.

``objects``     one row per node, link, input and output; what every object
                has is a column, and so are properties of one known type
``properties``  the others: (object_id, key, vtype, l, d, b, t, source_id)
``contain``     (axis, parent_id, child_id)
``declared``    (port_id, kind, type, role, domain, address), one row per address
``routes``      (requiring_domain, providing_domain)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import Cell

OBJECT = (
    "object_id long, kind string, name string, type string, external_id string, axis string, node_id long, "
    "from_id long, to_id long, derived boolean, address array<string>, role string, domain string, links long"
)
PROPERTY = "object_id long, key string, vtype string, l long, d double, b boolean, t string, source_id int"
CONTAIN = "axis string, parent_id long, child_id long"
DECLARED = "port_id long, kind string, type string, role string, domain string, address string"
ROUTE = "requiring_domain string, providing_domain string"
#: Intrinsic keys: column and type.
INTRINSIC = {
    "$id": ("object_id", "LONG"),
    "$name": ("name", "TEXT"),
    "$type": ("type", "TEXT"),
    "$externalId": ("external_id", "TEXT"),
    "$axis": ("axis", "TEXT"),
    "$address": ("address", "ADDRESSES"),
    "$role": ("role", "TEXT"),
    "$domain": ("domain", "TEXT"),
    "$node": ("node_id", "LONG"),
    "$links": ("links", "LONG"),
    "$from": ("from_id", "LONG"),
    "$to": ("to_id", "LONG"),
}
FIELD = {"LONG": "long", "DOUBLE": "double", "BOOLEAN": "boolean", "TEXT": "text"}


@dataclass(frozen=True)
class Graph:
    objects: DataFrame
    contain: DataFrame
    properties: DataFrame | None = None
    declared: DataFrame | None = None
    routes: DataFrame | None = None
    bound: dict[str, str] = field(default_factory=dict)  # keys that are columns of ``objects``, and their types
    # Where the levels of an axis are known: (parent_id, child_id) level by level from the roots, and the nodes that hold.
    levels: dict[str, list[DataFrame]] = field(default_factory=dict)
    holders: dict[str, DataFrame] = field(default_factory=dict)

    # Where ids tell the table and the key: the objects of an id, or of an external id, from the one table that may hold it.
    lookup: Callable[[int | str], DataFrame | None] | None = None

    def one(self, object_id: int) -> DataFrame:
        """The object of an id, read from the one table that may hold it where ids tell that."""
        found = self.lookup(object_id) if self.lookup else None
        return self.objects.where(F.col("object_id") == object_id) if found is None else found

    def named(self, external_id: str) -> DataFrame:
        """The objects of an external id; links have none."""
        found = self.lookup(external_id) if self.lookup else None
        return self.objects.where(F.col("external_id") == external_id) if found is None else found

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession

    def with_(self, **changes) -> Graph:
        # Other objects cannot be looked up where the old ones lie.
        return replace(self, **({"lookup": None} if "objects" in changes else {}) | changes)

    def cell(self, key: str) -> Cell:
        """Columns of a key in a frame that ``widened`` has made ready."""
        if key in INTRINSIC:
            column, kind = INTRINSIC[key]
            if kind == "ADDRESSES":
                return Cell(text=F.array_join(column, " "))
            if key == "$domain":
                return Cell(text=F.when(F.col("domain") != "", F.col("domain")))
            return Cell(**{FIELD[kind]: F.col(column)})
        if key in self.bound:
            return Cell(**{FIELD[self.bound[key]]: F.col(f"`{key}`")})
        return Cell(*[F.col(f"`{key}`.{c}") for c in "ldbt"])

    def widened(self, frame: DataFrame, keys) -> DataFrame:
        """``frame`` of objects with a column for each of the keys; only these are read from the properties."""
        loose = sorted(k for k in keys if k not in INTRINSIC and k not in self.bound)
        if not loose:
            return frame
        if self.properties is None:
            value = F.lit(None).cast("struct<l:bigint,d:double,b:boolean,t:string>")
            return frame.withColumns({k: value for k in loose})
        own = self.properties.where(F.col("key").isin(loose))
        wide = own.groupBy(F.col("object_id").alias("_owner")).agg(
            *[F.first(F.when(F.col("key") == k, F.struct("l", "d", "b", "t")), ignorenulls=True).alias(k) for k in loose]
        )
        return frame.join(wide, F.col("object_id") == F.col("_owner"), "left").drop("_owner")

    def nodes(self) -> DataFrame:
        return self.objects.where(F.col("kind") == "NODE")


def graph_of(spark: SparkSession, objects=(), properties=(), contain=(), declared=(), routes=()) -> Graph:
    """A small graph from rows, for fixtures."""
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Graph(frame(objects, OBJECT), frame(contain, CONTAIN), frame(properties, PROPERTY), frame(declared, DECLARED), frame(routes, ROUTE))
