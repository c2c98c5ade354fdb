"""Queries over the bound graph, each with the same question as SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import assembly, demand, derived, feed, folds, groupings, guards, links, mutations, placement, views
from .operators.derived import Rule
from .operators.select import matched, matched_ids
from .plans.path import Path
from .sources import feeds, frames, tpch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

C, S, P, O, N, R = "3000000000000 + c_custkey", "4000000000000 + s_suppkey", "5000000000000 + p_partkey", "6000000000000 + o_orderkey", "2000000000000 + n_nationkey", "1000000000000 + r_regionkey"
LINK = "10000000000000 + l_orderkey * 1000000 + l_suppkey"
NODES = f"""(select {R} as object_id from region union all select {N} from nation union all select {C} from customer
  union all select {S} from supplier union all select {P} from part union all select {O} from orders)"""
PORTS = """(select 7000000000000 + s_suppkey as object_id, 4000000000000 + s_suppkey as node_id from supplier
  union all select 8000000000000 + o_orderkey, 6000000000000 + o_orderkey from orders union all select 9000000000000 + p_partkey, 5000000000000 + p_partkey from part)"""
LINKS = f"(select distinct {LINK} as object_id, l_orderkey as o, l_suppkey as s, 4000000000000 + l_suppkey as f, 6000000000000 + l_orderkey as t from lineitem)"
SHIP = """(select l_orderkey as o, l_suppkey as s, sum(l_quantity::decimal(18,2))::double as quantity,
  sum(l_extendedprice::decimal(18,2) * (1 - l_discount)::decimal(5,2))::double as revenue, count(*) as lines from lineitem group by all)"""
PLACED = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def selects(name: str, selector: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: matched_ids(tpch.bind(spark, d), selector)
    ORACLES[name] = sql


selects("sel_everything", "", f"select object_id from {NODES} union all select object_id from {PORTS} union all select object_id from {LINKS}")
selects("sel_kind", "node", f"select object_id from {NODES}")
selects("sel_kind_link", "link", f"select object_id from {LINKS}")
selects("sel_prop_eq", "node[segment=BUILDING]", f"select {C} as object_id from customer where c_mktsegment = 'BUILDING'")
selects("sel_prop_neq", "node[segment!=BUILDING]", f"select {C} as object_id from customer where c_mktsegment <> 'BUILDING'")
selects("sel_present", "node[acctbal]", f"select {C} as object_id from customer union all select {S} from supplier")
selects("sel_contains", "node[brand~'#1']", f"select {P} as object_id from part where contains(p_brand, '#1')")
selects("sel_order_cmp", "node[acctbal>=5000.5]", f"select {C} as object_id from customer where c_acctbal >= 5000.5 union all select {S} from supplier where s_acctbal >= 5000.5")
selects("sel_long_eq", "node[size=15]", f"select {P} as object_id from part where p_size = 15")
selects("sel_text_number", "node[priority>1], node[size<=2]", f"select {P} as object_id from part where p_size <= 2")
selects("sel_contains_number", "node[size~'5']", f"select {P} as object_id from part where contains(p_size::varchar, '5')")
selects("sel_intrinsic_id", "*[$id>=5000000000010][$id<5000000000020]", f"select {P} as object_id from part where p_partkey between 10 and 19")
selects("sel_and", "node[$type=customer][acctbal>5000] & [segment=BUILDING]", f"select {C} as object_id from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'")
selects("sel_or", "node[$type=supplier][acctbal<0], node[size>48]", f"select {S} as object_id from supplier where s_acctbal < 0 union all select {P} from part where p_size > 48")
selects("sel_not", "node[$type=customer] & ![acctbal>0]", f"select {C} as object_id from customer where not coalesce(c_acctbal > 0, false)")
selects("sel_not_absent", "node & !*[acctbal]", f"select object_id from {NODES} where object_id not between 3000000000000 and 4999999999999")
selects("sel_precedence", "!node & input , node[$type=region]", f"select object_id from {PORTS} where object_id >= 8000000000000 union all select {R} from region")
selects("sel_under", "node[$type=customer][acctbal>5000] & under(placement, /region:ASIA)", f"select {C} as object_id from {PLACED} where r_name = 'ASIA' and c_acctbal > 5000")
selects("sel_under_wildcard", "under(placement, /*/NATION_3)", f"select {C} as object_id from customer where c_nationkey = 3 union all select {S} from supplier where s_nationkey = 3")
selects("sel_under_typed", "under(placement, /region:EUROPE/nation:*)", f"select {C} as object_id from {PLACED} where r_name = 'EUROPE' union all select {S} from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
selects("sel_under_id", "under(placement, /#1000000000001)", f"select {N} as object_id from nation where n_regionkey = 1 union all select {C} from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 union all select {S} from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1")
selects("sel_not_under", "node[$type=supplier] & !under(placement, /AFRICA)", f"select {S} as object_id from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'AFRICA'")
selects("sel_under_other_axis", "under(ownership, /#3000000000007)", f"select {O} as object_id from orders where o_custkey = 7")
selects("sel_between", "between(node[$type=supplier][acctbal<1000], node[status=F])", f"select object_id from {LINKS} join supplier on s = s_suppkey join orders on o = o_orderkey where s_acctbal < 1000 and o_orderstatus = 'F'")
selects("sel_touching", "link[quantity>=100] & touching(node[$type=supplier][acctbal<1000], node[total>400000])", f"select {LINK.replace('l_orderkey', 'o').replace('l_suppkey', 's')} as object_id from {SHIP} join supplier on s = s_suppkey join orders on o = o_orderkey where quantity >= 100 and (s_acctbal < 1000 or o_totalprice > 400000)")
selects("sel_on", "output & on(node[acctbal>9000]), on(node[size=50])", "select 7000000000000 + s_suppkey as object_id from supplier where s_acctbal > 9000 union all select 9000000000000 + p_partkey from part where p_size = 50")
selects("sel_not_between", "link[lines>1] & !touching(node[$type=supplier][acctbal>0])", f"select {LINK.replace('l_orderkey', 'o').replace('l_suppkey', 's')} as object_id from {SHIP} join supplier on s = s_suppkey where lines > 1 and s_acctbal <= 0")


@query("find_external_id", f"select {C} as object_id, 'customer' as type from customer where c_custkey = 42")
def find_external_id(spark, d):
    return tpch.bind(spark, d).named("customer:42").select("object_id", "type")


@query("find_id", f"select {S} as object_id, s_name as name from supplier where s_suppkey = 7")
def find_id(spark, d):
    return tpch.bind(spark, d).one(4 * tpch.UNIT + 7).select("object_id", "name")


@query(
    "snapshot_object",
    """select 3000000000042 as object_id, k as key, v as value from (select unnest(['$id', '$name', '$type', '$externalId', 'acctbal', 'segment']) as k,
    unnest(['3000000000042', c_name, 'customer', 'customer:42', c_acctbal::varchar, c_mktsegment]) as v from customer where c_custkey = 42)""",
)
def snapshot_object(spark, d):
    return views.snapshot_object(tpch.bind(spark, d), 3 * tpch.UNIT + 42).select("object_id", F.explode("properties").alias("key", "value"))


@query("link_endpoints", f"select object_id as link_id, 7000000000000 + s as from_port, f as from_node, 8000000000000 + o as to_port, t as to_node from {LINKS}")
def link_endpoints(spark, d):
    return links.endpoints(tpch.bind(spark, d))


@query("node_ports", "select 7000000000005 as object_id from supplier where s_suppkey = 5")
def node_ports(spark, d):
    return links.node_ports(tpch.bind(spark, d), 4 * tpch.UNIT + 5, "OUTPUT")


@query("path_of", f"""select {R} as object_id, '/region:' || replace(r_name, '*', '\\*') as path from region union all
  select {N}, '/region:' || r_name || '/nation:' || n_name from nation join region on n_regionkey = r_regionkey union all
  select {C}, '/region:' || r_name || '/nation:' || n_name || '/customer:' || replace(c_name, '#', '\\#') from {PLACED} union all
  select {S}, '/region:' || r_name || '/nation:' || n_name || '/supplier:' || replace(s_name, '#', '\\#') from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def path_of(spark, d):
    return placement.path_of(tpch.bind(spark, d), "placement")


@query("resolve_path", f"select {N} as object_id from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_name = 'NATION_2'")
def resolve_path(spark, d):
    return placement.resolve(tpch.bind(spark, d), "placement", Path.parse("/region:ASIA/NATION_2"))


@query("children", f"select 'placement' as axis, {C} as object_id from customer where c_nationkey = 4 union all select 'placement', {S} from supplier where s_nationkey = 4")
def children(spark, d):
    return placement.children(tpch.bind(spark, d), 2 * tpch.UNIT + 4)


@query("parents", f"select 'placement' as axis, 2000000000000 + c_nationkey as object_id from customer where c_custkey = 11")
def parents(spark, d):
    return placement.parents(tpch.bind(spark, d), 3 * tpch.UNIT + 11)


@query("ancestors", f"""select {N} as object_id, 1 as depth, 1000000000000 + n_regionkey as root from nation union all
  select {C}, 2, 1000000000000 + n_regionkey from customer join nation on c_nationkey = n_nationkey union all
  select {S}, 2, 1000000000000 + n_regionkey from supplier join nation on s_nationkey = n_nationkey""")
def ancestors(spark, d):
    return placement.ancestors(tpch.bind(spark, d), "placement").select("object_id", F.size("chain").alias("depth"), F.col("chain")[0]["id"].alias("root"))


@query("placement_faults", "select 'none' as fault, 0::bigint as object_id where false")
def placement_faults(spark, d):
    return placement.faults(tpch.bind(spark, d))


DECLARED = f"""d as (
  select distinct 7000000000000 + l_suppkey as port_id, 'OUTPUT' as kind, 'supply' as type, 'provide' as role, case when s_acctbal < 0 then '' else r_name end as domain, 'part:' || l_partkey as address
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select distinct 8000000000000 + l_orderkey, 'INPUT', 'demand', 'require', r_name, 'part:' || l_partkey
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 9000000000000 + p_partkey, 'INPUT', 'stock', 'require', '', 'part:' || p_partkey from part)"""
DRAWN = "select distinct p.port_id as from_id, r.port_id as to_id, p.address as name, p.type from d p join d r on p.address = r.address and p.role = 'provide' and r.role = 'require' and (p.domain = r.domain or p.domain = ''{})"


def routes(spark) -> DataFrame:
    return spark.createDataFrame([("ASIA", "EUROPE"), ("", "AFRICA")], "requiring_domain string, providing_domain string")


@query("addr_links", f"with {DECLARED} " + DRAWN.format(""))
def addr_links(spark, d):
    return links.draw(tpch.declared(spark, d))


ROUTED = " or (r.domain = 'ASIA' and p.domain = 'EUROPE') or (r.domain = '' and p.domain = 'AFRICA')"


@query("addr_links_routed", f"with {DECLARED} " + DRAWN.format(ROUTED))
def addr_links_routed(spark, d):
    return links.draw(tpch.declared(spark, d), routes(spark))


@query("addr_unmatched", f"with {DECLARED}, m as ({DRAWN.format('')}) select distinct port_id from d where role = 'require' and port_id not in (select to_id from m)")
def addr_unmatched(spark, d):
    own = tpch.declared(spark, d)
    drawn = links.draw(own).select(F.col("to_id").alias("_to")).distinct()
    return own.where("role = 'require'").select("port_id").distinct().join(drawn, F.col("port_id") == F.col("_to"), "left_anti")


@query("addr_any_address", f"with {DECLARED} select distinct port_id from d where role = 'require' and address = 'part:77'")
def addr_any_address(spark, d):
    graph = tpch.bind(spark, d)
    ports = graph.declared.where("role = 'require'").groupBy(F.col("port_id").alias("_port")).agg(F.array_sort(F.collect_set("address")).alias("_addresses"))
    objects = graph.objects.join(ports, F.col("object_id") == F.col("_port"), "left").withColumn("address", F.col("_addresses")).drop("_port", "_addresses")
    return matched(graph.with_(objects=objects), 'input[$address="part:77"]').select(F.col("object_id").alias("port_id"))


@query("addr_link_count", f"""with {DECLARED}, m as ({DRAWN.format('')}), e as (select from_id as p from m union all select to_id from m)
  select object_id as port_id, count(p) as links from {PORTS} x left join e on object_id = p group by 1""")
def addr_link_count(spark, d):
    graph = tpch.bind(spark, d)
    ports = graph.objects.where(F.col("kind").isin("INPUT", "OUTPUT")).select(F.col("object_id").alias("_port"))
    counts = links.drawn_counts(graph.declared)
    return ports.join(counts, F.col("_port") == F.col("port_id"), "left").select(F.col("_port").alias("port_id"), F.coalesce("links", F.lit(0)).alias("links"))


MONEY = "sum({}::decimal(18,2))"


def cents(column: str) -> F.Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(F.col(column) * 100).cast("long")


def customer_summands(graph) -> DataFrame:
    return graph.objects.where("kind = 'NODE' and type = 'customer'").select("object_id", cents("acctbal").alias("l"), F.lit(None).cast("double").alias("d"))


def fold_sql(aggregate: str) -> str:
    return f"select 2000000000000 + c_nationkey as object_id, {aggregate} as l, count(c_acctbal) as known, count(*) as total from customer group by 1"


for _fold, _sql in (("SUM", "sum(round(c_acctbal * 100)::bigint)::bigint"), ("MAX", "max(round(c_acctbal * 100)::bigint)"), ("MIN", "min(round(c_acctbal * 100)::bigint)")):
    QUERIES[f"fold_{_fold.lower()}_children"] = lambda spark, d, fold=_fold: folds.over_children(tpch.bind(spark, d).contain, customer_summands(tpch.bind(spark, d)), fold, "placement").select("object_id", "l", "known", "total")
    ORACLES[f"fold_{_fold.lower()}_children"] = fold_sql(_sql)


@query("fold_known_total", """select 2000000000000 + k as object_id, sum(v)::bigint as l, count(v) as known, count(*) as total from
  (select c_nationkey as k, case when c_acctbal >= 0 then round(c_acctbal * 100)::bigint end as v from customer union all select s_nationkey, null from supplier) group by 1""")
def fold_known_total(spark, d):
    graph = tpch.bind(spark, d)
    value = F.when((F.col("type") == "customer") & (F.col("acctbal") >= 0), cents("acctbal"))
    summands = graph.objects.where("kind = 'NODE' and type in ('customer', 'supplier')").select("object_id", value.alias("l"), F.lit(None).cast("double").alias("d"))
    return folds.over_children(graph.contain, summands, "SUM", "placement").select("object_id", "l", "known", "total")


@query("fold_double_children", "select 2000000000000 + c_nationkey as object_id, max(c_acctbal) as d, count(*) as known from customer group by 1")
def fold_double_children(spark, d):
    graph = tpch.bind(spark, d)
    summands = graph.objects.where("kind = 'NODE' and type = 'customer'").select("object_id", F.lit(None).cast("long").alias("l"), F.col("acctbal").alias("d"))
    return folds.over_children(graph.contain, summands, "MAX", "placement").select("object_id", "d", "known")


def nested_derivations(spark, graph, key="balance", fold="SUM") -> DataFrame:
    """Nations fold their customers, regions fold their nations, under one key."""
    nodes = graph.objects.where("kind = 'NODE' and type in ('region', 'nation')")
    return nodes.select("object_id", F.lit(key).alias("key"), F.lit(fold).alias("fold"), F.lit(key).alias("child_key"), F.lit("customer").alias("child_type"))


@query("fold_nested", f"""with n as (select n_nationkey, n_regionkey, round(c_acctbal * 100)::bigint as v from customer join nation on c_nationkey = n_nationkey)
  select 2000000000000 + n_nationkey as object_id, sum(v)::bigint as l, count(v) as known, count(*) as total from n group by 1
  union all select 1000000000000 + n_regionkey, sum(v)::bigint, count(v), count(*) from n group by 1""")
def fold_nested(spark, d):
    graph = tpch.bind(spark, d)
    values = customer_summands(graph).select("object_id", F.lit("balance").alias("key"), "l", "d")
    out = folds.nested(nested_derivations(spark, graph), graph.contain.where("axis = 'placement'"), graph.nodes(), values, levels=2)
    return out.select("object_id", "l", "known", "total")


@query("fold_own_keys", f"select {P} as object_id, greatest(p_size * 1.0::double, p_retailprice) as d, 2::bigint as known, 2::bigint as total from part")
def fold_own_keys(spark, d):
    parts = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'part'")
    return folds.over_keys(parts, "object_id", [(F.col("size"), None), (None, F.col("price"))], "MAX").select("object_id", "d", "known", "total")


@query("fold_own_and_children", f"""select 3000000000000 + k as object_id, max(v) as l, count(v) as known, count(*) as total from
  (select c_custkey as k, round(c_acctbal * 100)::bigint as v from customer union all select o_custkey, round(o_totalprice * 100)::bigint from orders join customer on o_custkey = c_custkey) group by 1""")
def fold_own_and_children(spark, d):
    graph = tpch.bind(spark, d)
    orders = graph.objects.where("kind = 'NODE' and type = 'order'").select("object_id", cents("total").alias("l"), F.lit(None).cast("double").alias("d"))
    return folds.own_and_children(customer_summands(graph), graph.contain.where("axis = 'ownership'"), orders, "MAX").select("object_id", "l", "known", "total")


@query("fold_counts", "select 1000000000000 + n_regionkey as object_id, sum(n)::bigint as l, count(*) as known from (select n_regionkey, n_nationkey, count(c_custkey) as n from nation join customer on c_nationkey = n_nationkey group by all) group by 1")
def fold_counts(spark, d):
    graph = tpch.bind(spark, d)
    counts = folds.over_children(graph.contain, customer_summands(graph), "SUM", "placement").select("object_id", F.col("known").alias("l"), F.lit(None).cast("double").alias("d"))
    return folds.over_children(graph.contain, counts, "SUM", "placement").select("object_id", "l", "known")


def groups(name: str, selector: str, by, over, columns, sql: str) -> None:
    QUERIES[name] = lambda spark, d: groupings.group_by(tpch.bind(spark, d), selector, by, over).select(*columns)
    ORACLES[name] = sql


groups("group_key", "node[$type=customer]", ["segment"], [("top", "MAX", "acctbal")], ["name", "members", "top_d"], "select c_mktsegment as name, count(*) as members, max(c_acctbal) as top_d from customer group by 1")
groups("group_two_keys", "node[$type=order]", ["status", "priority"], [], ["key0", "key1", "members"], """select o_orderstatus as key0, '"' || o_orderpriority || '"' as key1, count(*) as members from orders group by all""")
groups("group_hop_from", "link", ["$from.$node", "$from.$role"], [("lines", "SUM", "lines")], ["key0", "key1", "members", "lines_l"], f"select (4000000000000 + s)::varchar as key0, 'provide' as key1, count(*) as members, sum(lines)::bigint as lines_l from {SHIP} group by 1")
groups("group_hop_node", "output", ["$node.$type"], [], ["name", "members"], "select 'supplier' as name, count(*) as members from supplier")
groups("group_parent", "node[$type=customer]", ["parent(placement)"], [("low", "MIN", "acctbal")], ["name", "members", "low_d"], "select (2000000000000 + c_nationkey)::varchar as name, count(*) as members, min(c_acctbal) as low_d from customer group by 1")
groups("group_parent_key", "node[$type=order]", ["parent(ownership).segment", "status"], [("most", "MAX", "total")], ["key0", "key1", "members", "most_d"], "select c_mktsegment as key0, o_orderstatus as key1, count(*) as members, max(o_totalprice) as most_d from orders join customer on o_custkey = c_custkey group by all")
groups("group_derive_each", "link[lines>0]", ["$to.$node"], [("lines", "SUM", "lines"), ("top", "MAX", "revenue"), ("low", "MIN", "quantity")], ["name", "members", "lines_l", "lines_known", "lines_total", "top_d", "low_d"], f"select (6000000000000 + o)::varchar as name, count(*) as members, sum(lines)::bigint as lines_l, count(*) as lines_known, count(*) as lines_total, max(revenue) as top_d, min(quantity) as low_d from {SHIP} group by 1")
groups("group_canonical_key", "node[$type=part]", ["brand", "size", "price"], [], ["name", "members"], "select p_brand || ',' || p_size || ',' || p_retailprice as name, count(*) as members from part group by 1")


@query("group_nodes", "select c_mktsegment as name, 'segment' as type, 'segments:' || c_mktsegment as external_id from customer group by all")
def group_nodes(spark, d):
    return groupings.group_nodes(groupings.group_by(tpch.bind(spark, d), "node[$type=customer]", ["segment"]), "segments", "segment")


@query("cascade_remove", f"""select object_id from {NODES} where object_id not in (select {S} from supplier where s_acctbal < 0) and object_id <> 6000000000003
  union all select object_id from {PORTS} where node_id not in (select {S} from supplier where s_acctbal < 0) and node_id <> 6000000000003
  union all select object_id from {LINKS} where f not in (select {S} from supplier where s_acctbal < 0) and t <> 6000000000003""")
def cascade_remove(spark, d):
    graph = tpch.bind(spark, d)
    gone = matched_ids(graph, "node[$type=supplier][acctbal<0], *[$id=6000000000003]")
    return mutations.remove(graph, gone).objects.select("object_id")


def stored(spark, d) -> DataFrame:
    """Balances of customers as loose properties, written by source 1."""
    rows = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'customer'")
    null = lambda t: F.lit(None).cast(t)
    return rows.select("object_id", F.lit("acctbal").alias("key"), F.lit("DOUBLE").alias("vtype"), null("long").alias("l"), F.col("acctbal").alias("d"), null("boolean").alias("b"), null("string").alias("t"), F.lit(1).alias("source_id"))


def writes(spark, d) -> DataFrame:
    """Two writes to each customer's balance: first 0, then itself, or its double for every third, or its removal for every seventh."""
    own = stored(spark, d)
    key = F.col("object_id") % 10**12
    value = F.when(key % 7 == 0, F.lit(None).cast("double")).when(key % 3 == 0, F.col("d") * 2).otherwise(F.col("d"))
    kind = F.when(key % 7 != 0, F.lit("DOUBLE"))
    first = own.withColumns({"d": F.lit(0.0), "seq": F.lit(1), "source_id": F.lit(2)})
    last = own.withColumns({"vtype": kind, "d": value, "seq": F.lit(2), "source_id": F.lit(3)})
    return first.unionByName(last)


@query("write_suppression", f"""select {C} as object_id, case when c_custkey % 7 <> 0 then 'DOUBLE' end as vtype, case when c_custkey % 7 <> 0 then c_acctbal * 2 end as d from customer
  where c_custkey % 7 = 0 or (c_custkey % 3 = 0 and c_acctbal <> 0)""")
def write_suppression(spark, d):
    return mutations.changes(stored(spark, d), writes(spark, d)).select("object_id", "vtype", "d")


@query("provenance", f"select {C} as object_id, case when c_custkey % 3 = 0 then c_acctbal * 2 else c_acctbal end as d, 3 as source_id from customer where c_custkey % 7 <> 0")
def provenance(spark, d):
    return mutations.apply(stored(spark, d), writes(spark, d)).select("object_id", "d", "source_id")


@query("retarget_link", f"select object_id, case when s = 5 then 7000000000006 else 7000000000000 + s end as from_id, 8000000000000 + o as to_id from {LINKS}")
def retarget_link(spark, d):
    graph = tpch.bind(spark, d)
    moves = graph.objects.where("kind = 'LINK' and from_id = 7000000000005").select(F.col("object_id").alias("link_id"), F.lit(7 * tpch.UNIT + 6).alias("from_id"), F.lit(None).cast("long").alias("to_id"))
    return mutations.retarget(graph.objects, moves).where("kind = 'LINK'").select("object_id", "from_id", "to_id")


@query("move_child", f"select {C} as child_id, 2000000000000 + case when c_nationkey = 3 then 4 else c_nationkey end as parent_id from customer")
def move_child(spark, d):
    graph = tpch.bind(spark, d)
    own = graph.contain.where("axis = 'placement' and child_id between 3000000000000 and 3999999999999")
    placed = own.where("parent_id = 2000000000003").select("axis", F.lit(2 * tpch.UNIT + 4).alias("parent_id"), "child_id")
    return mutations.move(own, placed).select("child_id", "parent_id")


@query("identity_faults", "select 'x' as external_id, 0::bigint as n where false")
def identity_faults(spark, d):
    return mutations.identity_faults(tpch.bind(spark, d).objects)


VIEW = "node[$type=customer][acctbal>9000], node[$type=nation]"
VIEW_SQL = f"""v as (select {C} as object_id, 'customer' as type, c_name as name, 'customer:' || c_custkey as ext, null as axis, c_acctbal as bal, c_mktsegment as seg from customer where c_acctbal > 9000
  union all select {N}, 'nation', n_name, 'nation:' || n_nationkey, 'placement', null, null from nation),
  e as (select object_id, unnest(['$id', '$name', '$type', '$externalId', '$axis', 'acctbal'{{seg}}]) as key, unnest([object_id::varchar, name, type, ext, axis, bal::varchar{{segv}}]) as value from v)"""


def as_text(records: DataFrame) -> F.Column:
    return F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), F.col("t"))


SNAPSHOT_SQL = "with {} select 'ADDED' as change, object_id, null::bigint as parent_id, null::varchar as key, null::varchar as value from v union all select 'PROPERTY_CHANGED', object_id, null, key, value from e where value is not null union all select 'CONTAINED', 3000000000000 + c_custkey, 2000000000000 + c_nationkey, null, null from customer where c_acctbal > 9000"


@query("view_snapshot", SNAPSHOT_SQL.format(VIEW_SQL.format(seg=", 'segment'", segv=", seg")))
def view_snapshot(spark, d):
    records = views.snapshot(tpch.bind(spark, d), VIEW)
    return records.select("change", "object_id", "parent_id", "key", as_text(records).alias("value"))


@query("view_snapshot_keys", SNAPSHOT_SQL.format(VIEW_SQL.format(seg="", segv="")))
def view_snapshot_keys(spark, d):
    records = views.snapshot(tpch.bind(spark, d), VIEW, ["acctbal"])
    return records.select("change", "object_id", "parent_id", "key", as_text(records).alias("value"))


@query("view_port_closure", f"""with k as (select {LINK.replace('l_orderkey', 'o').replace('l_suppkey', 's')} as id, o, s from {SHIP} where quantity >= 80)
  select id as object_id from k union select 7000000000000 + s from k union select 8000000000000 + o from k""")
def view_port_closure(spark, d):
    return views.members(tpch.bind(spark, d), "link[quantity>=80]").select("object_id")


def changed(spark, d):
    """Two states of the customers: in the second, balances of every third are halved and those of nation 3 moved to nation 4."""
    graph = tpch.bind(spark, d)
    third = (F.col("type") == "customer") & (F.col("object_id") % 3 == 0)
    objects = graph.objects.withColumn("acctbal", F.when(third, F.col("acctbal") / 2).otherwise(F.col("acctbal")))
    moved = (F.col("axis") == "placement") & (F.col("parent_id") == 2 * tpch.UNIT + 3)
    contain = graph.contain.withColumn("parent_id", F.when(moved, 2 * tpch.UNIT + 4).otherwise(F.col("parent_id")))
    return graph, graph.with_(objects=objects, contain=contain, levels={}, holders={})


DELTA_SQL = f"""with c as (select {C} as id, c_name, c_custkey, c_mktsegment, c_nationkey, c_acctbal as a, case when ({C}) % 3 = 0 then c_acctbal / 2 else c_acctbal end as z from customer)
  select 'REMOVED' as change, id as object_id, null::bigint as parent_id, null::varchar as key, null::double as d from c where a > 2000 and z <= 2000
  union all select 'PROPERTY_CHANGED', id, null, 'acctbal', z from c where a > 2000 and z > 2000 and a <> z
  union all select case k when 0 then 'UNCONTAINED' else 'CONTAINED' end, id, 2000000000003 + k, null, null from c, (select unnest([0, 1]) as k) where a > 2000 and z > 2000 and c_nationkey = 3"""


@query("view_delta", DELTA_SQL)
def view_delta(spark, d):
    before, after = changed(spark, d)
    return views.delta(before, after, "node[$type=customer][acctbal>2000], node[$type=nation]").select("change", "object_id", "parent_id", "key", "d")


@query("view_membership_records", f"""with c as (select {C} as id, c_acctbal as a, case when ({C}) % 3 = 0 then c_acctbal / 2 else c_acctbal end as z from customer)
  select case when z < 2000 then 'ADDED' else 'REMOVED' end as change, id as object_id from c where (a < 2000) <> (z < 2000)""")
def view_membership_records(spark, d):
    before, after = changed(spark, d)
    return views.delta(before, after, "node[$type=customer][acctbal<2000]").where("change in ('ADDED', 'REMOVED')").select("change", "object_id")


@query("view_touch", "select 'acctbal' as key, c_acctbal as d from customer where c_custkey = 9")
def view_touch(spark, d):
    return views.touched(tpch.bind(spark, d), 3 * tpch.UNIT + 9).where("key = 'acctbal'").select("key", "d")


@query("view_replica", f"select {C} as object_id, case when ({C}) % 3 = 0 then c_acctbal / 2 else c_acctbal end as d from customer where c_acctbal > 2000 and case when ({C}) % 3 = 0 then c_acctbal / 2 else c_acctbal end > 2000")
def view_replica(spark, d):
    before, after = changed(spark, d)
    selector = "node[$type=customer][acctbal>2000]"
    log = views.snapshot(before, selector).withColumn("seq", F.lit(0)).unionByName(views.delta(before, after, selector).withColumn("seq", F.lit(1)))
    return views.replica(log).where("key = 'acctbal'").select("object_id", "d")


PLACES = "o as (select 1000000000000 + r_regionkey as id, r_name as name, 'region' as type, 'region:' || r_regionkey as ext from region union all select 2000000000000 + n_nationkey, n_name, 'nation', 'nation:' || n_nationkey from nation)"


@query("view_frames", f"""with {PLACES}, c as (select 0 as rank, id, '["+",' || id || ',"NODE"]' as item from o
  union all select 2, 2000000000000 + n_nationkey, '["c",' || (2000000000000 + n_nationkey) || ',' || (1000000000000 + n_regionkey) || ']' from nation
  union all select 4, id, '["p",' || id || ',1,"placement",2,"' || ext || '",3,"' || name || '",4,"' || type || '"]' from o)
  select 'places' as view, 3 as seq, id // 1000 as part, '{{"view":"places","seq":3,"version":7,"snapshot":true,"changes":[' || string_agg(item, ',' order by rank, id) || '],"keys":{{"1":"$axis","2":"$externalId","3":"$name","4":"$type"}}}}' as frame from c group by part""")
def view_frames(spark, d):
    return frames.frames(views.snapshot(tpch.bind(spark, d), "node[$type=region], node[$type=nation]"), "places", 3, True, 7)


@query("view_frame_changes", f"""with {PLACES} select '+' as change, id as object_id, 'NODE' as first, null::varchar as second from o union all select 'c', 2000000000000 + n_nationkey, (1000000000000 + n_regionkey)::varchar, null from nation
  union all select 'p', id, unnest(['$name', '$type', '$externalId', '$axis']), unnest([name, type, ext, 'placement']) from o""")
def view_frame_changes(spark, d):
    """The frames read again, as a client would."""
    return frames.changes(view_frames(spark, d))


@query("view_frame_ports", f"""with k as (select {LINK.replace('l_orderkey', 'o').replace('l_suppkey', 's')} as id, o, s, quantity, revenue, lines from {SHIP} where quantity >= 80)
  select 'p' as change, 7000000000000 + s as object_id, count(*) filter (where false) as told from k group by s union all select 'p', 8000000000000 + o, 0 from k group by o""")
def view_frame_ports(spark, d):
    """Ports come with their links; no frame states their external ids."""
    told = frames.changes(frames.frames(views.snapshot(tpch.bind(spark, d), "link[quantity>=80]"), "ports", 0, True))
    ports = told.where(f"change = 'p' and object_id < {9 * tpch.UNIT}")
    return ports.groupBy("change", "object_id").agg(F.count(F.when(F.col("first") == "$externalId", 1)).alias("told"))


@query("view_delta_enters", f"""with c as (select {C} as id, c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal as a, case when ({C}) % 3 = 0 then c_acctbal / 2 else c_acctbal end as z from customer),
  n as (select * from c where not a < 2000 and z < 2000), p as (select *, case when c_nationkey = 3 then 4 else c_nationkey end as nation from c where z < 2000)
  select 'ADDED' as change, id as object_id, null::bigint as parent_id, null::varchar as key, null::varchar as value from n
  union all select 'PROPERTY_CHANGED', id, null, unnest(['$id', '$name', '$type', '$externalId', 'acctbal', 'segment']), unnest([id::varchar, c_name, 'customer', 'customer:' || c_custkey, z::varchar, c_mktsegment]) from n
  union all select 'PROPERTY_CHANGED', id, null, 'acctbal', z::varchar from c where a < 2000 and z < 2000 and a <> z
  union all select 'CONTAINED', id, 2000000000000 + nation, null, null from p where not a < 2000 or c_nationkey = 3
  union all select 'UNCONTAINED', id, 2000000000003, null, null from c where a < 2000 and z < 2000 and c_nationkey = 3""")
def view_delta_enters(spark, d):
    """Objects enter with all of their properties and pairs; those that stay tell what is new."""
    before, after = changed(spark, d)
    records = views.delta(before, after, "node[$type=customer][acctbal<2000], node[$type=nation]")
    return records.select("change", "object_id", "parent_id", "key", as_text(records).alias("value"))


@query("query_properties", f"select {P} as object_id, unnest(['$id', '$name', '$type', '$externalId', 'brand', 'size', 'price']) as key, unnest([({P})::varchar, p_name, 'part', 'part:' || p_partkey, p_brand, p_size::varchar, p_retailprice::varchar]) as value from part where p_size = 7")
def query_properties(spark, d):
    rows = views.query(tpch.bind(spark, d), "node[size=7]")
    return rows.select("object_id", "key", as_text(rows).alias("value"))


WORDS = """w as (
  select (user_id % 2)::int as source_id, epoch_us(ts) * 8 as seq, case when event_type = 'error' and user_id % 5 = 0 then 'REMOVED' else 'OBSERVED' end as word,
    'user:' || user_id as external_id, event_type as version, (user_id % 4)::int as scope, props as payload from events
  union all select (s % 2)::int, epoch_us(day + interval 1 day) * 8 - 8 + s, 'COMPLETE', null, null, s::int, null
    from (select distinct date_trunc('day', ts)::timestamp as day from events), (select unnest([0, 1, 2, 3]) as s)),
  m as (select *, sum((word = 'COMPLETE')::int) over (partition by source_id, scope order by seq) as rnd, sum((word <> 'OBSERVED')::int) over (partition by source_id order by seq) as epoch from w),
  n as (select *, sum((word = 'REMOVED')::int) over (partition by source_id, external_id order by seq) as gone from m where word in ('OBSERVED', 'REMOVED')),
  o as (select *, row_number() over l as rn, lag(version) over l as pv, lag(rnd) over l as pr, lag(gone) over l as pg from n where word = 'OBSERVED' window l as (partition by source_id, external_id order by seq))"""


@query("feed_coalesce", f"with {WORDS} select source_id, external_id, max(seq) as seq from m where word = 'OBSERVED' group by source_id, external_id, epoch")
def feed_coalesce(spark, d):
    return feed.coalesced(tpch.words(spark, d)).select("source_id", "external_id", "seq")


@query("feed_source", f"""with {WORDS} select source_id, external_id, scope, version from w x where word = 'OBSERVED'
  and not exists (select 1 from w r where r.word = 'REMOVED' and r.external_id = x.external_id and r.seq >= x.seq)
  qualify row_number() over (partition by source_id, external_id order by seq desc) = 1""")
def feed_source(spark, d):
    """The entries of two sources that read the events by themselves, row group by row group."""
    feeds.register(spark, "event_words", lambda options: [tpch.Events(n, options["path"]) for n in (0, 1)])
    return feed.alive(spark.read.format("event_words").load(f"{d}/events.parquet")).select("source_id", "external_id", "scope", "version")


@query("feed_version_dedup", f"with {WORDS} select source_id, external_id, seq, version from o where rn = 1 or version <> pv or gone <> pg or rnd - pr >= 2")
def feed_version_dedup(spark, d):
    return feed.observations(tpch.words(spark, d)).where("materialized").select("source_id", "external_id", "seq", "version")


ALIVE = "a as (select x.* from (select * from o qualify row_number() over (partition by source_id, external_id order by seq desc) = 1) x join (select source_id, scope, max(rnd) as k from m group by all) using (source_id, scope) where k - rnd <= 1 and gone = (select count(*) from w r where r.word = 'REMOVED' and r.external_id = x.external_id))"


@query("feed_sweep", f"with {WORDS}, {ALIVE} select source_id, external_id, scope, version from a")
def feed_sweep(spark, d):
    return feed.alive(tpch.words(spark, d)).select("source_id", "external_id", "scope", "version")


DEMAND = "dm as (select distinct source_id, external_id, case when hash_key % 3 = 0 then 0 else 2 end as level, case when hash_key % 3 = 1 then mx - 86400000000 * 8 end as raised from (select source_id, external_id, substr(external_id, 6)::bigint as hash_key, (select max(seq) from w) as mx from w where external_id is not null))"
SPARED = "b as (select source_id, scope, seq as begun from w where word = 'COMPLETE' qualify row_number() over (partition by source_id, scope order by seq desc) = 2)"


@query("feed_sweep_demand", f"""with {WORDS}, {DEMAND}, {SPARED}, l as (select * from w where word = 'OBSERVED' qualify row_number() over (partition by source_id, external_id order by seq desc) = 1)
  select l.source_id, l.external_id, l.scope, l.version from l left join b using (source_id, scope) left join dm using (source_id, external_id)
  where (coalesce(level = 0, false) or begun is null or l.seq > begun or coalesce(raised > begun, false)) and not exists (select 1 from w r where r.word = 'REMOVED' and r.source_id = l.source_id and r.external_id = l.external_id and r.seq >= l.seq)""")
def feed_sweep_demand(spark, d):
    words = tpch.words(spark, d)
    number = F.substring("external_id", 6, 20).cast("long")
    raised = (words.agg(F.max("seq")).first()[0] or 0) - 86_400_000_000 * 8
    wanted = words.where("external_id is not null").select("source_id", "external_id").distinct().select(
        "source_id", "external_id", F.when(number % 3 == 0, 0).otherwise(2).alias("level"), F.when(number % 3 == 1, F.lit(raised)).alias("raised")
    )
    return feed.alive(words, wanted).select("source_id", "external_id", "scope", "version")


@query("feed_removed", f"with {WORDS}, {ALIVE} select distinct source_id, external_id from n where external_id not in (select external_id from a)")
def feed_removed(spark, d):
    words = tpch.words(spark, d)
    return words.where("external_id is not null").select("source_id", "external_id").distinct().join(feed.alive(words), ["source_id", "external_id"], "left_anti")


@query("feed_claims", f"with {WORDS}, {ALIVE} select 'scope:' || scope as object_key, count(*) as claims from a group by 1")
def feed_claims(spark, d):
    entries = feed.alive(tpch.words(spark, d)).withColumn("object_key", F.concat(F.lit("scope:"), F.col("scope").cast("string")))
    return feed.claims(entries)


@query("feed_state", "select (k)::int as source_id, 'CONVERGED' as state from (select unnest([0, 1]) as k)")
def feed_state(spark, d):
    return feed.states(tpch.words(spark, d))


def user(row: dict, emit: assembly.Emit) -> None:
    """A user's node in the node of its scope, with the version seen; a user whose number ends in 9 is refused."""
    if row["external_id"].endswith("9"):
        raise ValueError("no such user")
    scope = emit.node(f"scope:{row['scope']}", str(row["scope"]), "scope")
    own = emit.node(row["external_id"], row["external_id"], "user")
    emit.contain(scope, own, "placement")
    emit.set(own, "version", row["version"])
    emit.set(scope, "last", row["external_id"])


def user_writes(spark, d) -> DataFrame:
    return assembly.materialize(feed.alive(tpch.words(spark, d)), user)


KNOWN = f"with {WORDS}, {ALIVE}, g as (select * from a where external_id not like '%9')"


@query("assembly_objects", KNOWN + " select external_id as object, 'user' as type, 1::bigint as claims from g union all select 'scope:' || scope, 'scope', count(*) from g group by 1")
def assembly_objects(spark, d):
    return assembly.objects(user_writes(spark, d)).select("object", "type", "claims")


@query("assembly_containment", KNOWN + " select 'placement' as axis, 'scope:' || scope as parent, external_id as child from g")
def assembly_containment(spark, d):
    return assembly.containment(user_writes(spark, d))


@query("assembly_values", KNOWN + " select external_id as object, 'version' as key, version as t from g union all select 'scope:' || scope, 'last', arg_max(external_id, (source_id, external_id)) from g group by scope")
def assembly_values(spark, d):
    return assembly.values(user_writes(spark, d)).select("object", "key", "t")


@query("assembly_rejected", f"with {WORDS}, {ALIVE} select source_id, external_id, 'ValueError: no such user' as error from a where external_id like '%9'")
def assembly_rejected(spark, d):
    return assembly.rejected(user_writes(spark, d))


def owner(row: dict, emit: assembly.Emit) -> None:
    """What a customer's user was last seen doing, at the customer and in an account of its own; every ninth asks for a port as a node."""
    key = row["external_id"].removeprefix("user:")
    known = emit.node(f"customer:{key}", f"customer {key}", "customer")
    account = emit.node(f"account:{key}", key, "account")
    emit.contain(known, account, "accounts")
    emit.set(known, "seen", row["version"])
    if int(key) % 9 == 4:
        emit.node("supplier:1>out", "out", "supply")
    if int(key) % 9 == 5:
        emit.remove(account)


def with_owners(spark, d):
    graph = tpch.bind(spark, d)
    writes = assembly.allowed(graph, assembly.materialize(feed.alive(tpch.words(spark, d)), owner))
    return assembly.applied(graph, writes)


SEEN = f"with {WORDS}, {ALIVE}, g as (select *, substr(external_id, 6)::bigint as k from a where substr(external_id, 6)::bigint % 9 <> 4)"


@query("assembly_applied", SEEN + " select 'customer:' || k as external_id, k in (select c_custkey from customer) as known, version as seen from g")
def assembly_applied(spark, d):
    graph = with_owners(spark, d)
    own = matched(graph, "node[$type=customer][seen]").select("object_id", "external_id", (F.col("object_id") < 4 * tpch.UNIT).alias("known"))
    seen = graph.properties.where("key = 'seen'").select("object_id", F.col("t").alias("seen"))
    return own.join(seen, "object_id").select("external_id", "known", "seen")


@query("assembly_applied_under", SEEN + " select 'account:' || k as external_id from g where k % 9 <> 5 and k in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def assembly_applied_under(spark, d):
    graph = with_owners(spark, d)
    path = groupings.with_paths(graph, matched(graph, "node[$type=account]"), ["parent(accounts).segment"])
    return path[0].where(path[1]["parent(accounts).segment"].text == "BUILDING").select("external_id")


@query("assembly_conflicts", f"with {WORDS}, {ALIVE} select source_id, external_id, 'another kind: supplier:1>out' as error from a where substr(external_id, 6)::bigint % 9 = 4")
def assembly_conflicts(spark, d):
    return assembly.conflicts(tpch.bind(spark, d), assembly.materialize(feed.alive(tpch.words(spark, d)), owner))


@query("assembly_released", f"with {WORDS}, {ALIVE} select distinct external_id as object from w where word = 'OBSERVED' and external_id not like '%9' and external_id not in (select external_id from a) union all select distinct 'scope:' || scope from w where word = 'OBSERVED' and external_id not like '%9' and scope not in (select scope from a where external_id not like '%9')")
def assembly_released(spark, d):
    words = tpch.words(spark, d)
    once = words.where("word = 'OBSERVED'").select("source_id", "external_id", "scope").distinct().withColumn("version", F.lit("v"))
    return assembly.released(assembly.materialize(once, user), user_writes(spark, d))


def clients(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "client string, base int")


def overrides(spark, d) -> DataFrame:
    rows = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'customer'")
    fine = rows.where("acctbal > 9000").select(F.lit("a").alias("client"), "object_id", F.lit(2).alias("level"))
    off = rows.where("segment = 'BUILDING'")
    return fine.unionAll(off.select(F.lit("b").alias("client"), "object_id", F.lit(0).alias("level"))).unionAll(off.where("acctbal < 5000").select(F.lit("c").alias("client"), "object_id", F.lit(0).alias("level")))


LEVEL = "case when c_acctbal > 9000 then 2 when c_mktsegment = 'BUILDING' and c_acctbal < 5000 then 0 else 1 end"


@query("demand_level", f"select {C} as object_id, {LEVEL} as level from customer")
def demand_level(spark, d):
    nodes = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'customer'")
    return demand.levels(nodes, clients(spark), overrides(spark, d))


@query("demand_drop", f"select {C} as object_id, 'acctbal' as key from customer where {LEVEL} < 1")
def demand_drop(spark, d):
    return demand.dropped(stored(spark, d), demand_level(spark, d), {"acctbal": 1}, 1)


@query("demand_notify", f"select 'customer:' || c_custkey as external_id, {LEVEL} as level from customer where {LEVEL} <> 2")
def demand_notify(spark, d):
    nodes = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'customer'")
    nobody = clients(spark).where("false")
    before = demand.levels(nodes, nobody, overrides(spark, d))
    return demand.notices(before, demand_level(spark, d), nodes.select("object_id", "external_id"))


#: Nations and regions know their best customer, regions the least of these and how many they are; parts and customers fold what is theirs.
RULES = (
    Rule("node[$type=nation]", "best", "MAX", children="acctbal", child_type="customer"),
    Rule("node[$type=region]", "best", "MAX", children="best"),
    Rule("node[$type=region]", "floor", "MIN", children="best"),
    Rule("node[$type=region]", "people", "SUM", children="best.known"),
    Rule("node[$type=part]", "worth", "SUM", own=("size", "price")),
    Rule("node[$type=customer]", "dearest", "MAX", children="total"),
)
BEST = "(select n_nationkey, n_regionkey, max(c_acctbal) as best, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by all)"


@query("sel_on_derived", f"""select {N} as object_id from {BEST} where best > 9950 union all select {R} from region where r_regionkey in (select n_regionkey from {BEST} where best > 9950)
  union all select {P} from part where p_size + p_retailprice < 950 union all select 3000000000000 + o_custkey from orders group by o_custkey having count(*) >= 18""")
def sel_on_derived(spark, d):
    graph = derived.derive(tpch.bind(spark, d), RULES)
    return matched_ids(graph, "node[best>9950], node[worth<950], node[dearest.total>=18]")


@query("fold_strata", f"""with g as (select 1000000000000 + n_regionkey as object_id, max(best) as best, min(best) as low, sum(n)::bigint as n, count(*) as nations, count(best) as known from {BEST} group by 1)
  select object_id, 'best' as key, null::bigint as l, best as d from g where best is not null union all select object_id, 'best.known', n, null from g union all select object_id, 'best.total', n, null from g
  union all select object_id, 'floor', null, low from g where low is not null union all select object_id, 'floor.known', known, null from g union all select object_id, 'floor.total', nations, null from g
  union all select object_id, 'people', n, null from g union all select object_id, 'people.known', nations, null from g union all select object_id, 'people.total', nations, null from g""")
def fold_strata(spark, d):
    graph = derived.derive(tpch.bind(spark, d), RULES)
    return views.query(graph, "node[$type=region]").where("not startswith(key, '$')").select("object_id", "key", "l", "d")


@query("fold_sum_mixed", f"select {P} as object_id, 'worth' as key, p_size + p_retailprice as d from part")
def fold_sum_mixed(spark, d):
    graph = derived.derive(tpch.bind(spark, d), RULES[4:5])
    return graph.properties.select("object_id", "key", "d")


@query("fold_sum_wraps", f"""select 2000000000000 + c_nationkey as object_id, ((sum(9000000000000000000::hugeint - c_custkey) + 9223372036854775808::hugeint) % 18446744073709551616::hugeint - 9223372036854775808::hugeint)::bigint as l from customer group by 1""")
def fold_sum_wraps(spark, d):
    graph = tpch.bind(spark, d)
    large = graph.objects.where("kind = 'NODE' and type = 'customer'").select("object_id", (F.lit(9 * 10**18) - F.col("object_id") % tpch.UNIT).alias("l"), F.lit(None).cast("double").alias("d"))
    return folds.over_children(graph.contain, large, "SUM", "placement").select("object_id", "l")


@query("fold_rule_faults", f"""select 'declared twice' as fault, {R} as object_id, 'best' as key from region union all select 'not a node', 7000000000000 + s_suppkey, 'sold' from supplier
  union all select 'reserved key', {N}, '$size' from nation union all select 'own key is derived', {N}, 'above' from nation union all select 'no such fold', {P}, 'mean' from part
  union all select 'written by a source', {C}, 'acctbal' from customer""")
def fold_rule_faults(spark, d):
    graph = tpch.bind(spark, d)
    rules = [
        Rule("node[$type=region]", "best", "MAX", children="acctbal"), Rule("node[$type=region]", "best", "MIN", children="acctbal"),
        Rule("output", "sold", "SUM", children="lines"), Rule("node[$type=nation]", "$size", "SUM", own=("size",)),
        Rule("node[$type=nation]", "above", "SUM", own=("below",)), Rule("node[$type=nation]", "below", "SUM", own=("size",)), Rule("node[$type=nation]", "below", "SUM", own=("size",)),
        Rule("node[$type=part]", "mean", "AVG", own=("size",)), Rule("node[$type=customer]", "acctbal", "SUM", own=("lines",)),
    ]
    return derived.faults(derived.declarations(graph, rules), graph.objects, stored(spark, d))


def with_segments(spark, d):
    return groupings.as_nodes(tpch.bind(spark, d), "segments", "segment", "node[$type=customer]", ["segment"], [("top", "MAX", "acctbal")])


@query("sel_group_node", "select c_mktsegment as name, 'segments:' || c_mktsegment as external_id from customer group by all having max(c_acctbal) > 9990 or c_mktsegment = 'BUILDING'")
def sel_group_node(spark, d):
    return matched(with_segments(spark, d), "node[$type=segment][top>9990], node[$type=segment][segment=BUILDING][top.total>0]").select("name", "external_id")


@query("view_with_groups", """with g as (select c_mktsegment as s, max(c_acctbal) as top from customer group by 1)
  select 'ADDED' as change, null::varchar as key, null::varchar as value from g union all select 'PROPERTY_CHANGED', unnest(['$name', '$type', '$externalId', 'segment', 'top']), unnest([s, 'segment', 'segments:' || s, s, top::varchar]) from g""")
def view_with_groups(spark, d):
    records = views.snapshot(with_segments(spark, d), "node[$type=segment]", ["segment", "top"])
    return records.where("key is null or key <> '$id'").select("change", "key", as_text(records).alias("value"))


@query("group_not_member", "select type as name, count(*) as members from (select 'region' as type from region union all select 'nation' from nation union all select 'customer' from customer union all select 'supplier' from supplier union all select 'part' from part union all select 'order' from orders) group by 1")
def group_not_member(spark, d):
    return groupings.group_by(with_segments(spark, d), "node", ["$type"]).select("name", "members")


groups("group_missing_part", "node", ["brand"], [("smallest", "MIN", "size")], ["name", "members", "smallest_l"], "select p_brand as name, count(*) as members, min(p_size)::bigint as smallest_l from part group by 1")


@query("guard_writes", f"""select 'no such object' as fault, {C} + 500000000000 as object_id, 'note' as key from customer where c_custkey % 10 = 0
  union all select 'reserved key', {C}, '$name' from customer where c_mktsegment = 'BUILDING' and c_custkey % 10 <> 0 union all select 'derived', {N}, 'best' from nation where n_nationkey in (select c_nationkey from customer)""")
def guard_writes(spark, d):
    graph = derived.derive(tpch.bind(spark, d), RULES[:1])
    customers = graph.objects.where("kind = 'NODE' and type = 'customer'")
    tenth = F.col("object_id") % 10 == 0
    own = customers.select(F.when(tenth, F.col("object_id") + 500_000_000_000).otherwise(F.col("object_id")).alias("object_id"), F.when(~tenth & (F.col("segment") == "BUILDING"), "$name").otherwise("note").alias("key"))
    nations = graph.objects.where("kind = 'NODE' and type = 'nation'").select("object_id", F.lit("best").alias("key"))
    return guards.write_faults(own.unionAll(nations), graph.objects, graph.properties)


@query("guard_links", f"""select unnest(['from no output', 'to no input']) as fault, object_id from {LINKS} where s % 2 = 0 union all select 'to nothing', object_id from {LINKS} where s % 2 = 1 and o % 5 = 0""")
def guard_links(spark, d):
    graph = tpch.bind(spark, d)
    even, fifth = F.col("from_id") % 2 == 0, F.col("to_id") % 5 == 0
    links_ = graph.objects.where("kind = 'LINK'").select(
        "object_id", F.when(even, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(even, F.col("from_id")).when(fifth, 0).otherwise(F.col("to_id")).alias("to_id")
    )
    return guards.link_faults(links_, graph.objects)


@query("guard_placement", f"select distinct case when 1 + c_custkey % 10 in (select s_suppkey from supplier) then 'parent is no node' else 'parent is nothing' end as fault, 7000000000001 + c_custkey % 10 as object_id from customer where c_custkey % 3 = 0 union all select 'in itself', {C} from customer where c_custkey % 3 = 1")
def guard_placement(spark, d):
    graph = tpch.bind(spark, d)
    key = F.col("object_id") % tpch.UNIT
    parent = F.when(key % 3 == 0, F.lit(7 * tpch.UNIT + 1) + key % 10).when(key % 3 == 1, F.col("object_id")).otherwise(F.lit(tpch.UNIT))
    placed = graph.objects.where("kind = 'NODE' and type = 'customer'").select(parent.alias("parent_id"), F.col("object_id").alias("child_id"))
    return guards.placement_faults(placed, graph.objects)


@query("guard_removal", "select 'group' as fault, count(distinct c_mktsegment) as n from customer having n > 0")
def guard_removal(spark, d):
    graph = with_segments(spark, d)
    return guards.removal_faults(matched_ids(graph, "node[segment]"), graph.objects).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("placement_faults_found", f"""select 'two parents' as fault, {C} as object_id from customer where c_custkey % 7 = 0 union all select 'two axes', 2000000000003
  union all select 'cycle', 2000000000002 union all select 'cycle', 1000000000000 + n_regionkey from nation where n_nationkey = 2""")
def placement_faults_found(spark, d):
    graph = tpch.bind(spark, d)
    row = lambda axis, parent, child: F.struct(F.lit(axis).alias("axis"), parent.alias("parent_id"), child.alias("child_id"))
    key = F.col("child_id") % tpch.UNIT
    nation = lambda n: F.lit(2 * tpch.UNIT) + n
    customer = F.col("child_id").between(3 * tpch.UNIT, 4 * tpch.UNIT - 1)
    again = F.when(customer & (key % 7 == 0), row("placement", nation((F.col("parent_id") + 1) % 25), F.col("child_id")))
    round_ = F.when(F.col("child_id") == nation(2), row("placement", F.col("child_id"), F.col("parent_id")))
    other = F.when(F.col("child_id") == nation(3), row("other", F.col("child_id"), F.lit(5 * tpch.UNIT + 1)))
    more = graph.contain.where("axis = 'placement'").select(F.explode(F.filter(F.array(again, round_, other), lambda x: x.isNotNull())).alias("_r")).select("_r.*")
    return placement.faults(graph.with_(contain=graph.contain.unionByName(more), levels={}, holders={}))


@query("identity_faults_found", "select 'twin' as external_id, count(*) as n from customer where c_custkey % 50 = 0 having n > 1 union all select ' ', count(*) from supplier where s_suppkey % 5 = 0 having count(*) > 0")
def identity_faults_found(spark, d):
    objects = tpch.bind(spark, d).objects
    key, of = F.col("object_id") % tpch.UNIT, lambda t: (F.col("kind") == "NODE") & (F.col("type") == t)
    named = F.when(of("customer") & (key % 50 == 0), "twin").when(of("supplier") & (key % 5 == 0), " ").otherwise(F.col("external_id"))
    return mutations.identity_faults(objects.withColumn("external_id", named))


@query("demand_interests", f"select {C} as object_id, case when c_acctbal > 9000 or c_mktsegment = 'BUILDING' then 2 else 0 end as level from customer")
def demand_interests(spark, d):
    """Client b is forgotten, c changes twice, and d comes."""
    nodes = tpch.bind(spark, d).objects.where("kind = 'NODE' and type = 'customer'")
    changes = spark.createDataFrame([("b", None, 2), ("c", 2, 1), ("c", 0, 3), ("d", 0, 1)], "client string, base int, seq long")
    wish = lambda rows, client, seq: rows.select(F.lit(client).alias("client"), "object_id", F.lit(2).alias("level"), F.lit(seq).cast("long").alias("seq"))
    given = wish(nodes.where("segment = 'BUILDING'"), "c", 3).unionAll(wish(nodes.where("acctbal < 0"), "c", 1)).unionAll(wish(nodes, "b", 2))
    return demand.levels(nodes, *demand.set_interests(clients(spark), overrides(spark, d), changes, given))


#: The flagship: the minimum that needs the parser, the planner, placement and pruning.
FLAGSHIP = "sel_under"
