"""Queries about change: what a batch does to links, folds, groups and views, without working the whole out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import assembly, derived, feed, folds, groupings, links, reach, strata, upkeep
from .operators.derived import Rule
from .operators.select import matched
from .queries import DECLARED, DELTA_SQL, DRAWN, PLACED, SHIP, WORDS, C, changed, nested_derivations, query, routes
from .sources import tpch

UNIT = tpch.UNIT


@query("fold_sum_double", "select 2000000000000 + c_nationkey as object_id, sum(floor(c_acctbal * 1024)::hugeint)::double / 1024 as d, 3 * count(*) as known from customer group by 1")
def fold_sum_double(spark, d):
    """Each customer gives a balance, and a large number in and out again; nothing of the balances is lost."""
    graph = tpch.bind(spark, d)
    own = graph.objects.where("kind = 'NODE' and type = 'customer'").select("object_id", (F.floor(F.col("acctbal") * 1024) / 1024).alias("v"))
    large = F.pow(F.lit(2.0), (60 + F.col("object_id") % 400).cast("double"))
    summands = own.select("object_id", F.lit(None).cast("long").alias("l"), F.explode(F.array("v", large, -large)).alias("d"))
    return folds.over_children(graph.contain, summands, "SUM", "placement").select("object_id", "d", "known")


def balances(graph, factor=None) -> DataFrame:
    """(object_id, key, l, d): balances of customers as doubles that binary fractions hold."""
    value = F.floor(F.col("acctbal") * 1024) / 1024
    own = graph.objects.where("kind = 'NODE' and type = 'customer'")
    return own.select("object_id", F.lit("balance").alias("key"), F.lit(None).cast("long").alias("l"), (value if factor is None else value * factor).alias("d"))


UPKEEP = f"""(select 2000000000000 + case when c_nationkey = 3 then 4 else c_nationkey end as n, n_regionkey as r, case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then floor(c_acctbal * 1024) / 512 else floor(c_acctbal * 1024) / 1024 end as v
  from customer join nation on case when c_nationkey = 3 then 4 else c_nationkey end = n_nationkey)"""


@query("fold_upkeep", f"""with u as {UPKEEP}, a as (select n as object_id, v from u union all select 1000000000000 + r, v from u)
  select object_id, 'balance' as key, sum((v * 1024)::hugeint)::double / 1024 as d, count(v) as known, count(*) as total from a group by 1
  union all select object_id, 'best', max(v), count(v), count(*) from a group by 1""")
def fold_upkeep(spark, d):
    """A batch doubles every seventh balance, removes every eleventh and moves the customers of a nation to another; sums and maxima of nations and regions follow."""
    graph = tpch.bind(spark, d)
    key = F.col("object_id") % UNIT
    before = balances(graph)
    after = before.where(key % 11 != 0).withColumn("d", F.when(key % 7 == 0, F.col("d") * 2).otherwise(F.col("d")))
    placed = graph.contain.where("axis = 'placement'")
    rules = nested_derivations(spark, graph).unionByName(nested_derivations(spark, graph, "best", "MAX"))
    below = lambda contain: folds.leaves(rules, contain, graph.nodes(), levels=2).withColumn("leaf_key", F.lit("balance"))
    state = upkeep.begin(below(placed), before)
    # The writes of the batch, and the pairs that it moves.
    written = before.where((key % 11 == 0) | (key % 7 == 0))
    changes = upkeep.value_changes(written, after.where(key % 7 == 0))
    moved = placed.where(F.col("parent_id") == 2 * UNIT + 3)
    regions = placed.where("child_id < 3000000000000 and child_id >= 2000000000000")
    now = regions.unionByName(placed.where((F.col("parent_id") != 2 * UNIT + 3) & (F.col("child_id") >= 3 * UNIT))).unionByName(moved.withColumn("parent_id", F.lit(2 * UNIT + 4)))
    ends = regions.where(F.col("child_id").isin(2 * UNIT + 3, 2 * UNIT + 4))
    went = below(moved.unionByName(ends.where(F.col("child_id") == 2 * UNIT + 3)))
    came = below(moved.withColumn("parent_id", F.lit(2 * UNIT + 4)).unionByName(ends.where(F.col("child_id") == 2 * UNIT + 4)))
    out = upkeep.uphold(state, below(now), changes, after, went, came).values()
    return out.where("total > 0").select("object_id", "key", "d", "known", "total")


CHANGED = """dd as (select * from d where not (role = 'provide' and port_id % 9 = 0) and not (port_id = 7000000000001 and role = 'provide')
    union all select port_id, kind, type, role, 'AFRICA', address from d where role = 'provide' and port_id % 9 = 0)"""


def _lines(d: str, also: str) -> str:
    return DRAWN.format(also).replace("from d p join d r", f"from {d} p join {d} r")


@query("addr_links_delta", f"""with {DECLARED}, {CHANGED}, old as ({_lines('d', " or (r.domain = 'ASIA' and p.domain = 'EUROPE') or (r.domain = '' and p.domain = 'AFRICA')")}),
  new as ({_lines('dd', " or (r.domain = 'EUROPE' and p.domain = 'AMERICA') or (r.domain = '' and p.domain = 'AFRICA')")})
  select -1 as sign, * from (select * from old except select * from new) union all select 1, * from (select * from new except select * from old)""")
def addr_links_delta(spark, d):
    """Every ninth supplier goes to another domain, one withdraws, one route is denied and one allowed."""
    before = tpch.declared(spark, d)
    provide = F.col("role") == "provide"
    went = before.where(provide & ((F.col("port_id") % 9 == 0) | (F.col("port_id") == 7 * UNIT + 1)))
    came = before.where(provide & (F.col("port_id") % 9 == 0)).withColumn("domain", F.lit("AFRICA"))
    route = lambda a, b: spark.createDataFrame([(a, b)], "requiring_domain string, providing_domain string")
    return links.redraw(before, went, came, routes(spark), denied=route("ASIA", "EUROPE"), allowed=route("EUROPE", "AMERICA"))


@query("group_moves", """with k as (select c_custkey as id, c_mktsegment as a, case when c_custkey % 7 = 0 then null when c_mktsegment = 'MACHINERY' then 'TOOLS' when c_custkey % 5 = 0 then 'BUILDING' else c_mktsegment end as z from customer),
  o as (select a as name, count(*) as n from k group by 1), n as (select z as name, count(*) as n from k where z is not null group by 1)
  select coalesce(o.name, n.name) as name, coalesce(n.n, 0) as members, case when o.n is null then 'MADE' when n.n is null then 'REMOVED' else 'CHANGED' end as state
  from o full join n on o.name = n.name where o.n is distinct from n.n""")
def group_moves(spark, d):
    """Customers change their segments; only those that do are grouped again."""
    graph = tpch.bind(spark, d)
    key = F.col("object_id") % UNIT
    own = F.col("type") == "customer"
    fresh = F.when(key % 7 == 0, F.lit(None).cast("string")).when(F.col("segment") == "MACHINERY", "TOOLS").when(key % 5 == 0, "BUILDING").otherwise(F.col("segment"))
    after = graph.with_(objects=graph.objects.withColumn("segment", F.when(own, fresh).otherwise(F.col("segment"))))
    ids = graph.nodes().where(own & ((key % 7 == 0) | (key % 5 == 0) | (F.col("segment") == "MACHINERY"))).select("object_id")
    counts = groupings.group_by(graph, "node[$type=customer]", ["segment"]).select("name", "members")
    keys = lambda g: groupings.member_keys(g, "node[$type=customer]", ["segment"], ids)
    return groupings.moved(counts, groupings.moves(keys(graph), keys(after)))


@query("view_delta_reach", DELTA_SQL)
def view_delta_reach(spark, d):
    before, after = changed(spark, d)
    third = before.nodes().where((F.col("type") == "customer") & (F.col("object_id") % 3 == 0)).select("object_id")
    pairs = before.contain.where((F.col("axis") == "placement") & (F.col("parent_id") == 2 * UNIT + 3))
    change = reach.Change(third, None, pairs.unionByName(pairs.withColumn("parent_id", F.lit(2 * UNIT + 4))))
    return reach.delta(before, after, "node[$type=customer][acctbal>2000], node[$type=nation]", change).select("change", "object_id", "parent_id", "key", "d")


SUPPLIED = f"""k as (select 10000000000000 + o * 1000000 + s as id, o, s, a, z from {SHIP} join (select s_suppkey, s_acctbal as a, case when s_suppkey % 5 = 0 then -s_acctbal else s_acctbal end as z from supplier) on s = s_suppkey where quantity >= 40),
  m as (select id, a < 0 as a, z < 0 as z from k union all select 7000000000000 + s, bool_or(a < 0), bool_or(z < 0) from k group by 1 union all select 8000000000000 + o, bool_or(a < 0), bool_or(z < 0) from k group by 1)"""


@query("view_reach_links", f"with {SUPPLIED} select case when z then 'ADDED' else 'REMOVED' end as change, id as object_id from m where a <> z")
def view_reach_links(spark, d):
    """Balances of suppliers change their sign: links at them, and the ports of these, come and go."""
    before = tpch.bind(spark, d)
    fifth = (F.col("type") == "supplier") & (F.col("object_id") % UNIT % 5 == 0)
    after = before.with_(objects=before.objects.withColumn("acctbal", F.when(fifth, -F.col("acctbal")).otherwise(F.col("acctbal"))))
    change = reach.Change(before.nodes().where(fifth).select("object_id"))
    records = reach.delta(before, after, "link[quantity>=40] & touching([$type=supplier][acctbal<0])", change)
    return records.where("change in ('ADDED', 'REMOVED')").select("change", "object_id")


@query("view_reach_below", f"""select case when n_nationkey = 3 then 'ADDED' else 'REMOVED' end as change, {C} as object_id from {PLACED} where c_acctbal > 5000
  and ((n_nationkey = 3 and r_name <> 'ASIA') or (n_nationkey <> 3 and r_name = 'ASIA' and n_nationkey % 2 = 0))""")
def view_reach_below(spark, d):
    """Nation 3 is placed in Asia, and even nations of Asia elsewhere: customers below them come and go."""
    before = tpch.bind(spark, d)
    named = lambda name: before.objects.where((F.col("type") == "region") & (F.col("name") == name)).select(F.col("object_id").alias("_r"))
    asia, other = named("ASIA").first()[0], named("EUROPE").first()[0]
    placed, child = F.col("axis") == "placement", F.col("child_id") % UNIT
    nation = placed & (F.col("child_id") < 3 * UNIT)
    into = nation & (child == 3) & (F.col("parent_id") != asia)
    out = nation & (child != 3) & (child % 2 == 0) & (F.col("parent_id") == asia)
    moved = before.contain.where(into | out)
    parent = F.when(into, asia).when(out, other).otherwise(F.col("parent_id"))
    after = before.with_(contain=before.contain.withColumn("parent_id", parent), levels={}, holders={})
    change = reach.Change(None, None, moved.unionByName(moved.withColumn("parent_id", parent)))
    records = reach.delta(before, after, "node[$type=customer][acctbal>5000] & under(placement, /region:ASIA)", change)
    return records.where("change in ('ADDED', 'REMOVED')").select("change", "object_id")


#: Nations know their best customer's size class and how many customers they have; groups of nations are made of that, and folded.
NATION_RULES = (
    Rule("node[$type=nation]", "owed", "SUM", children="low", child_type="customer"),
    Rule("node[$type=customer][acctbal<0]", "low", "SUM", own=("one",)),
)
BANDS = strata.Grouping("bands", "band", "node[$type=nation][owed.total>0]", ("parent(placement)", "owed"), (("owing", "SUM", "owed"), ("most", "MAX", "owed.total")))
OWED = "(select n_nationkey, n_regionkey, nullif(count(*) filter (c_acctbal < 0), 0) as owed, count(*) as total from nation join customer on c_nationkey = n_nationkey group by 1, 2)"


def with_ones(spark, d):
    """Customers carry a 1, so that a rule can count them."""
    graph = tpch.bind(spark, d)
    rows = graph.nodes().where(F.col("type") == "customer").select("object_id", F.lit("one").alias("key"), F.lit(1).cast("long").alias("l"), F.lit(None).cast("double").alias("d"))
    return graph.with_(properties=derived.property_rows(rows, 1))


@query("group_by_derived", f"select (1000000000000 + n_regionkey)::varchar || ',' || owed as name, count(*)::bigint as members, sum(owed)::bigint as owing, max(total)::bigint as most from {OWED} where owed is not null group by n_regionkey, owed")
def group_by_derived(spark, d):
    """Groups of nations by their region and by how many customers owe, which is derived; the groups fold derived values."""
    graph = strata.settle(with_ones(spark, d), NATION_RULES, [BANDS])
    keyed = graph.widened(graph.nodes().where("type = 'band'"), {"owing", "owing.total", "most"})
    return keyed.select("name", F.col("`owing.total`.l").alias("members"), F.col("owing.l").alias("owing"), F.col("most.l").alias("most"))


@query("group_folds_derived", f"""with b as (select n_regionkey, owed, sum(owed)::bigint as owing, count(*) as members from {OWED} where owed is not null group by 1, 2)
  select (1000000000000 + n_regionkey)::varchar || ',' || owed as name, 'band' as type, owing + members as weight from b where owing + members > 10
  union all select n_name, 'nation', owed * 2 from {OWED} join nation using (n_nationkey) where owed * 2 > 10""")
def group_folds_derived(spark, d):
    """A rule over the nodes of groups and over nations alike reads what groups fold and what other rules derive; a selector reads the rule."""
    rules = (
        *NATION_RULES[1:], NATION_RULES[0],
        Rule("node[$type=band]", "weight", "SUM", own=("owing", "owing.total")),
        Rule("node[$type=nation]", "weight", "SUM", children="twice", child_type="customer"),
        Rule("node[$type=customer][acctbal<0]", "twice", "SUM", own=("one", "also")),
    )
    graph = with_ones(spark, d)
    graph = graph.with_(properties=graph.properties.unionByName(graph.properties.withColumn("key", F.lit("also"))))
    out = strata.settle(graph, rules, [BANDS])
    keyed = out.widened(matched(out, "node[weight>10]"), {"weight"})
    return keyed.select("name", "type", F.col("weight.l").alias("weight"))


def flaky(row: dict, emit: assembly.Emit) -> None:
    """Observations of every third microsecond cannot be mapped."""
    if row["seq"] // 8 % 3 == 0:
        raise ValueError("not now")
    emit.set(emit.node(row["external_id"], row["external_id"], "user"), "version", row["version"])


@query("feed_failed_again", f"""with {WORDS}, b as (select *, seq // 8 % 3 = 0 as f, rn = 1 or version <> pv or gone <> pg or rnd - pr >= 2 as base from o),
  r as (select *, sum(base::int) over (partition by source_id, external_id order by seq) as run from b),
  t as (select *, min(f::int) over (partition by source_id, external_id, run order by seq rows between unbounded preceding and 1 preceding) as failing from r)
  select source_id, external_id, seq, version, case when f then 'ValueError: not now' end as error from t where base or failing = 1""")
def feed_failed_again(spark, d):
    return assembly.attempts(tpch.words(spark, d), flaky).select("source_id", "external_id", "seq", "version", "error")


def troubled(spark, d) -> DataFrame:
    """The words, and of some users' errors that their source is unavailable or available again; one source is closed before its last day."""
    words = tpch.words(spark, d)
    user = F.substring("external_id", 6, 20).cast("long") % 40
    event = words.where("version = 'error'").where(user.isin(3, 4, 5, 6))
    none = F.lit(None).cast("string")
    told = event.select("source_id", (F.col("seq") + 1).alias("seq"), F.when(user < 5, "UNAVAILABLE").otherwise("AVAILABLE").alias("word"), none.alias("external_id"), none.alias("version"), F.lit(None).cast("int").alias("scope"), F.when(user < 5, F.col("external_id")).alias("payload"))
    end = words.where("source_id = 1").agg(F.max("seq").alias("seq")).where("seq is not null")
    closed = end.select(F.lit(1).alias("source_id"), (F.col("seq") - 86_400_000_000 * 8).alias("seq"), F.lit("CLOSED").alias("word"), none.alias("external_id"), none.alias("version"), F.lit(None).cast("int").alias("scope"), none.alias("payload"))
    return words.unionByName(told).unionByName(closed)


STATES = f"""{WORDS}, e as (select source_id, seq, word, null as reason from w where word = 'COMPLETE'
  union all select source_id, seq + 1, case when substr(external_id, 6)::bigint % 40 < 5 then 'UNAVAILABLE' else 'AVAILABLE' end, case when substr(external_id, 6)::bigint % 40 < 5 then external_id end from w where version = 'error' and substr(external_id, 6)::bigint % 40 in (3, 4, 5, 6)
  union all select 1, max(seq) - 86400000000 * 8, 'CLOSED', null from w where source_id = 1 having max(seq) is not null),
  y as (select *, coalesce(last_value(case when word in ('UNAVAILABLE', 'AVAILABLE') then word = 'UNAVAILABLE' end ignore nulls) over (partition by source_id order by seq), false) as stale from e),
  z as (select *, case when bool_or(word = 'CLOSED') over p then 'CLOSED' when stale then 'STALE' when bool_or(word = 'COMPLETE' and not stale) over p then 'CONVERGED' else 'LOADING' end as state from y window p as (partition by source_id order by seq)),
  st as (select source_id::int as source_id, seq, state, case when state = 'STALE' then reason end as reason from z qualify state <> lag(state, 1, 'LOADING') over (partition by source_id order by seq))"""


@query("feed_state_changes", f"with {STATES} select * from st")
def feed_state_changes(spark, d):
    return feed.state_changes(troubled(spark, d))


def noted(row: dict, emit: assembly.Emit) -> None:
    """A source's node has its state, and why."""
    own = emit.node(row["external_id"], row["external_id"], "source")
    emit.set(own, "state", row["state"])
    emit.set(own, "reason", row["reason"])


@query("assembly_state_writes", f"""with {STATES}, l as (select 'source:' || source_id as object, arg_max(state, seq) as state, arg_max(struct_pack(r := reason), seq).r as reason from st group by source_id)
  select object, 'state' as key, state as t from l union all select object, 'reason', reason from l where reason is not null""")
def assembly_state_writes(spark, d):
    """What a feed comes to is mapped by the user's function as observations are; the last state stays."""
    return assembly.values(assembly.state_writes(feed.state_changes(troubled(spark, d)), noted)).select("object", "key", "t")
