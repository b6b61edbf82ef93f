"""Graphs: conversations as flows (a turn is an activity), regions, nations and customers as a lineage tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import classify as cl
from siltworks.operators import lineage as lin
from siltworks.plans.registry import query, table

# Lineage items: order -> customer -> nation -> region, names as a catalog writes them.
_ITEMS_SQL = """
    items as (
      select 'urn:li:dataset:(urn:li:dataPlatform:hive,c' || c_custkey || ',PROD)' as seed_urn,
        'urn:li:dataset:(urn:li:dataPlatform:s3,n' || c_nationkey || ',PROD)' as related_urn, 'DownstreamOf' as edge_type, c_custkey as o from customer
      union all select 'urn:li:dataFlow:(glue,o' || o_orderpriority || ',PROD)',
        case when o_orderkey % 10 = 0 then '' else 'urn:li:dataset:(urn:li:dataPlatform:hive,c' || o_custkey || ',PROD)' end, null, 1000000000 + o_orderkey from orders)"""


def items(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "'urn:li:dataset:(urn:li:dataPlatform:hive,c' || c_custkey || ',PROD)' as seed_urn",
        "'urn:li:dataset:(urn:li:dataPlatform:s3,n' || c_nationkey || ',PROD)' as related_urn", "'DownstreamOf' as edge_type", "c_custkey as o",
    )
    o = table(spark, sf, "orders").selectExpr(
        "'urn:li:dataFlow:(glue,o' || o_orderpriority || ',PROD)' as seed_urn",
        "case when o_orderkey % 10 = 0 then '' else 'urn:li:dataset:(urn:li:dataPlatform:hive,c' || o_custkey || ',PROD)' end as related_urn",
        "cast(null as string) as edge_type", "1000000000 + o_orderkey as o",
    )
    return c.unionByName(o)


_NODES_SQL = f"""
    {_ITEMS_SQL}, u as (select seed_urn as urn from items union select related_urn from items where related_urn <> ''),
    nodes as (select urn, case when urn like 'urn:li:dataFlow%' then 'dataFlow' else 'dataset' end as node_type,
      case when urn like '%glue%' then 'glue' when urn like '%hive%' then 'hive' else 's3' end as platform from u),
    edges as (select distinct related_urn as source_urn, seed_urn as target_urn, 'DownstreamOf' as edge_type from items where related_urn <> '')"""


@query("lineage_nodes", sql=f"with {_NODES_SQL} select * from nodes")
def lineage_nodes(spark, sf):
    return lin.lineage_nodes(items(spark, sf), "o")


@query("lineage_edges", sql=f"with {_NODES_SQL} select * from edges")
def lineage_edges(spark, sf):
    return lin.lineage_edges(items(spark, sf))


@query(
    "lineage_upstream",
    sql=f"""
    with {_NODES_SQL}
    select e.target_urn as urn, count(*) as n, min(e.source_urn) as first from edges e join nodes on e.source_urn = nodes.urn group by 1""",
)
def lineage_upstream(spark, sf):
    i = items(spark, sf)
    up = lin.neighbours(lin.lineage_nodes(i, "o"), lin.lineage_edges(i), "upstream")
    return up.groupBy("urn").agg(F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first"))


@query(
    "lineage_downstream",
    sql=f"""
    with {_NODES_SQL}
    select e.source_urn as urn, nodes.urn as neighbour, nodes.node_type, nodes.platform from edges e join nodes on e.target_urn = nodes.urn""",
)
def lineage_downstream(spark, sf):
    i = items(spark, sf)
    return lin.neighbours(lin.lineage_nodes(i, "o"), lin.lineage_edges(i), "downstream")


# A flow per conversation.  Turn t waits for t-1; every third one waits for t-2 as well, every fifth only on failure.
_ACTS = [
    "conv_id",
    "turn",
    "case when turn % 5 = 4 then 'fail_' else '' end || role || '_' || turn as name",
    "case turn % 6 when 0 then 'WebActivity' when 1 then 'Copy' when 2 then 'TridentNotebook' when 3 then 'IfCondition' when 4 then 'Office365Email' else 'Script' end as type",
    "case turn % 6 when 1 then 'Json' end as source_type",
    "case turn % 6 when 1 then case when conv_id % 2 = 0 then 'LakehouseTable' else 'Parquet' end end as sink_type",
    "case turn % 6 when 1 then 'api' end as source",
    "case turn % 6 when 1 then 'tbl' || turn end as sink",
]


def activities(spark, sf):
    return table(spark, sf, "conversations").selectExpr("role", *_ACTS)


_ACTS_SQL = f"""
    acts as (select role, {', '.join(_ACTS)} from conversations),
    edges as (select b.conv_id, a.name as source, b.name as target from acts a join acts b on a.conv_id = b.conv_id and (a.turn = b.turn - 1
      or (a.turn = b.turn - 2 and b.turn % 3 = 2)))"""


def edges(spark, sf):
    a = activities(spark, sf)
    later = a.select("conv_id", F.col("name").alias("target"), "turn").withColumn(
        "from_turn", F.explode(F.expr("case when turn % 3 = 2 then array(turn - 1, turn - 2) else array(turn - 1) end"))
    )
    return later.join(a.selectExpr("conv_id", "turn as from_turn", "name as source"), ["conv_id", "from_turn"]).select("conv_id", "source", "target")


@query(
    "flow_roots_and_ends",
    sql=f"""
    with {_ACTS_SQL}
    select conv_id, name, 'root' as kind from acts where not exists (select 1 from edges e where e.conv_id = acts.conv_id and e.target = acts.name)
    union all select conv_id, name, 'end' from acts where not exists (select 1 from edges e where e.conv_id = acts.conv_id and e.source = acts.name)""",
)
def flow_roots_and_ends(spark, sf):
    a, e = activities(spark, sf), edges(spark, sf)
    first = lin.roots(a, e, "conv_id").withColumn("kind", F.lit("root"))
    return first.unionByName(lin.terminals(a.select("conv_id", "name"), e, "conv_id").withColumn("kind", F.lit("end")))


@query(
    "flow_paths",
    sql=f"""
    with recursive {_ACTS_SQL.strip()},
    p as (
      select conv_id, [name] as path, name as cur from acts where turn = 0
      union all select p.conv_id, list_append(path, e.target), e.target from p join edges e on p.conv_id = e.conv_id and p.cur = e.source)
    select conv_id, array_to_string(path, '>') as path, contains(array_to_string(path, '>'), 'fail') as fails from p
    where not exists (select 1 from edges e where e.conv_id = p.conv_id and e.source = p.cur)""",
)
def flow_paths(spark, sf):
    return lin.execution_paths(activities(spark, sf), edges(spark, sf), "conv_id").withColumn("path", F.array_join("path", ">"))


@query(
    "flow_path_counts",
    sql=f"""
    with recursive {_ACTS_SQL.strip()},
    p as (
      select conv_id, name as root, name as cur, contains(lower(name), 'fail') as fails from acts where turn = 0
      union all select p.conv_id, root, e.target, fails or contains(lower(e.target), 'fail') from p join edges e on p.conv_id = e.conv_id and p.cur = e.source)
    select conv_id, root, cur as "end", fails, cast(count(*) as bigint) as paths from p
    where not exists (select 1 from edges e where e.conv_id = p.conv_id and e.source = p.cur) group by all""",
)
def flow_path_counts(spark, sf):
    """Ways through the conversations' flows from each root to each end, with and without a failure."""
    counts = lin.path_counts(activities(spark, sf), edges(spark, sf), "conv_id")
    return counts.withColumn("paths", F.col("paths").cast("bigint"))


@query(
    "flow_order",
    sql=f"with {_ACTS_SQL} select conv_id, name, turn as level, false as cyclic from acts",
)
def flow_order(spark, sf):
    return lin.dependency_order(activities(spark, sf), edges(spark, sf), "conv_id", "turn").drop("sort_key").withColumn(
        "level", F.col("level").cast("bigint")
    )


@query(
    "tree_order",
    sql="""
    select 'r' || r_regionkey as name, 0 as level from region
    union all select 'n' || n_nationkey, 1 from nation
    union all select 'c' || c_custkey, 2 from customer union all select 's' || s_suppkey, 2 from supplier""",
)
def tree_order(spark, sf):
    """Levels of the tree region - nation - customers and suppliers, one graph with hubs."""
    r = table(spark, sf, "region").selectExpr("0 as g", "'r' || r_regionkey as name", "cast(null as string) as source")
    n = table(spark, sf, "nation").selectExpr("0 as g", "'n' || n_nationkey as name", "'r' || n_regionkey as source")
    c = table(spark, sf, "customer").selectExpr("0 as g", "'c' || c_custkey as name", "'n' || c_nationkey as source")
    s = table(spark, sf, "supplier").selectExpr("0 as g", "'s' || s_suppkey as name", "'n' || s_nationkey as source")
    every = r.unionByName(n).unionByName(c).unionByName(s)
    e = every.where("source is not null").selectExpr("g", "source", "name as target")
    nodes = every.select("g", "name", F.lit(0).alias("o"))
    return lin.dependency_order(nodes, e, "g", "o").select("name", "level")


@query(
    "flow_texts",
    sql=f"""
    with {_ACTS_SQL}, v as (select conv_id, string_agg(name, ' -> ' order by turn) filter (where type <> 'Office365Email') as steps, max(source) as s, max(sink) as t,
      bool_or(type = 'IfCondition') as r from acts group by conv_id)
    select conv_id, coalesce(s, 'No explicit source') || ' -> ' || coalesce(steps, cast(conv_id as varchar)) || ' -> ' || coalesce(t, 'no explicit sink')
      || case when r then ' with validation gates' else '' end as flow from v""",
)
def flow_texts(spark, sf):
    a = activities(spark, sf)
    return lin.flow_text(a, "conv_id", ["turn"], F.col("source"), F.col("sink"), F.col("type") == "IfCondition")


@query(
    "flow_destinations",
    sql=f"""
    with {_ACTS_SQL}, t as (select conv_id, max(turn) as last from acts group by conv_id),
    a as (select acts.*, turn = last as is_end, coalesce(sink, case when type = 'TridentNotebook' then name end) as label from acts join t using (conv_id) where type <> 'Office365Email'),
    k as (select *, case when is_end and label is not null then 1 when label is not null then 2 when is_end and type <> 'IfCondition' then 3 end as rank from a),
    b as (select conv_id, min(rank) as rank, max(turn) filter (where rank = 2) as lt from k group by conv_id)
    select k.conv_id, coalesce(label, name) as name, ['terminal sink', 'last sink', 'terminal step'][k.rank] as why from k join b on k.conv_id = b.conv_id and k.rank = b.rank
    where k.rank <> 2 or turn = lt""",
)
def flow_destinations(spark, sf):
    return lin.destinations(activities(spark, sf), edges(spark, sf), "conv_id", "turn")


@query(
    "flow_stages",
    sql=f"""
    with {_ACTS_SQL}, e as (
      select conv_id, 0 as r, turn, 0 as p, 'SOURCE: ' || source as s from acts where source is not null
      union all select conv_id, 1, turn, 1, 'SOURCE: ' || name from acts where type = 'WebActivity'
      union all select conv_id, 1, turn, 2, 'STAGING: ' || sink from acts where sink is not null
      union all select conv_id, 1, turn, 3, 'TRANSFORMATION: ' || name from acts where type in ('TridentNotebook', 'Script')
      union all select conv_id, 1, turn, 4, 'DESTINATION: ' || sink from acts where sink_type = 'LakehouseTable'),
    f as (select conv_id, s, min((r, turn, p)) as o from e group by all)
    select conv_id, string_agg(s, ' -> ' order by o) as flow from f group by conv_id""",
)
def flow_stages(spark, sf):
    return lin.stage_flow(activities(spark, sf), "conv_id", "turn")


@query(
    "flow_structures",
    sql=f"""
    with {_ACTS_SQL}, n as (select conv_id, string_agg(regexp_replace(name, '_?\\d+$', '') || '::' || lower(type), ',' order by regexp_replace(name, '_?\\d+$', '') || '::' || lower(type)) as n from acts group by 1),
    e as (select conv_id, string_agg(regexp_replace(source, '_?\\d+$', '') || '->' || regexp_replace(target, '_?\\d+$', ''), ',' order by regexp_replace(source, '_?\\d+$', '') || '->' || regexp_replace(target, '_?\\d+$', '')) as e from edges group by 1),
    s as (select n.conv_id, n.n, e.e, max(turn) as t from n left join e using (conv_id) join acts on acts.conv_id = n.conv_id group by all)
    select min(conv_id) as conv_id from s group by n, e, t""",
)
def flow_structures(spark, sf):
    """The first conversation of each structure."""
    a, e = activities(spark, sf), edges(spark, sf)
    text = a.groupBy("conv_id").agg(F.max("turn").cast("string").alias("flow"))
    return lin.first_of_structure(lin.graph_signature(a, e, "conv_id", text), "conv_id").select("conv_id")


# Three flows per order, of 4 to 6 steps of one name and type: a path, the path with other numbers in reverse listing, a star.
_STEPS = "sequence(1, cast(3 + o_orderkey % 3 as int))"


@query(
    "flow_structures_wired",
    sql="""
    select min(3 * o_orderkey + v) as flow_id, count(*) as flows from orders, (select unnest([0, 1, 2]) as v) group by o_orderkey % 3, v = 2""",
)
def flow_structures_wired(spark, sf):
    """The first flow of each structure and the number of flows that have it; names and numbers of edges alone are equal in all."""
    keys, v = table(spark, sf, "orders").select("o_orderkey"), F.explode(F.array(*[F.lit(v) for v in range(3)])).alias("v")
    o = keys.select("o_orderkey", v)
    wired = o.select((3 * F.col("o_orderkey") + F.col("v")).alias("flow_id"), "v", F.explode(F.expr(_STEPS)).alias("i"))
    step = "concat('Step_', case v when 1 then 90 - {0} else {0} end)"
    e = wired.selectExpr("flow_id", f"case v when 2 then 'Step_0' else {step.format('(i - 1)')} end as source", f"{step.format('i')} as target")
    # the steps 0, 1, ... of each flow that has any: the distinct ends of its edges
    n = keys.distinct().select("o_orderkey", v).select((3 * F.col("o_orderkey") + F.col("v")).alias("flow_id"), "v", F.explode(F.expr(_STEPS.replace("sequence(1", "sequence(0"))).alias("i"))
    n = n.selectExpr("flow_id", f"{step.format('i')} as name", "'Copy' as type")
    text = o.select((3 * F.col("o_orderkey") + F.col("v")).alias("flow_id"), F.lit("copies").alias("flow"))
    signed = lin.graph_signature(n, e, "flow_id", text)
    return signed.groupBy("signature").agg(F.min("flow_id").alias("flow_id"), F.count(F.lit(1)).alias("flows")).drop("signature")


# Nested definitions: one per document.
NESTED = """
  '[{"name": "load_' || source || '", "type": "ForEach", "policy": {"retry": ' || doc_id % 3 || ', "timeout": "1h"}, "typeProperties": {"items": {"value": "' ||
  case when doc_id % 2 = 0 then '@activity(~Look up~).output.value' else '@range(1, 3)' end || '"}, "activities": [' ||
  '{"name": "copy", "type": "Copy", "dependsOn": [{"activity": "prep", "dependencyConditions": ["Failed"]}, {"activity": "init"}], "sink": "Json lakehouse"}, ' ||
  '{"type": "TridentNotebook", "typeProperties": {"parameters": {"target": "' || case when lang = 'en' then 'Gold from raw' else 'none' end || '"}}}]}}, ' ||
  '{"name": "check_' || doc_id || '", "type": "IfCondition", "dependsOn": [{"activity": "load_' || source || '"}], "typeProperties": {"ifTrueActivities": ' ||
  '[{"name": "mail", "type": "Office365Email", "to": "ops@x.example.com", "on": "' || case when doc_id % 4 = 0 then 'failure' else 'end' end || '"}], "ifFalseActivities": [{"name": "audit", "type": "Script"}]}}, ' ||
  '{"name": "pick", "type": "Switch", "typeProperties": {"cases": [{"value": "a", "activities": [{"name": "web", "type": "WebActivity"}]}], "defaultActivities": [{"name": "wait", "type": "Wait"}]}}]'"""


def nested(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(f"replace({NESTED}, '~', \"'\")").alias("activities"))
    return lin.activity_rows(d, "doc_id", "activities")


_TREE_SQL = """
    tree as (select doc_id, source, lang, unnest([
      {'pos': 0, 'name': 'load_' || source, 'type': 'ForEach', 'parent': null, 'scope': 'root', 'depth': 0, 'branch': null, 'deps': ''},
      {'pos': 1, 'name': 'copy', 'type': 'Copy', 'parent': 'load_' || source, 'scope': 'root.load_' || source, 'depth': 1, 'branch': 'ForEach', 'deps': 'prep,init'},
      {'pos': 2, 'name': 'TridentNotebook', 'type': 'TridentNotebook', 'parent': 'load_' || source, 'scope': 'root.load_' || source, 'depth': 1, 'branch': 'ForEach', 'deps': ''},
      {'pos': 3, 'name': 'check_' || doc_id, 'type': 'IfCondition', 'parent': null, 'scope': 'root', 'depth': 0, 'branch': null, 'deps': 'load_' || source},
      {'pos': 4, 'name': 'mail', 'type': 'Office365Email', 'parent': 'check_' || doc_id, 'scope': 'root.check_' || doc_id || '.ifTrue', 'depth': 1, 'branch': 'IfTrue', 'deps': ''},
      {'pos': 5, 'name': 'audit', 'type': 'Script', 'parent': 'check_' || doc_id, 'scope': 'root.check_' || doc_id || '.ifFalse', 'depth': 1, 'branch': 'IfFalse', 'deps': ''},
      {'pos': 6, 'name': 'pick', 'type': 'Switch', 'parent': null, 'scope': 'root', 'depth': 0, 'branch': null, 'deps': ''},
      {'pos': 7, 'name': 'web', 'type': 'WebActivity', 'parent': 'pick', 'scope': 'root.pick.case0', 'depth': 1, 'branch': 'a', 'deps': ''},
      {'pos': 8, 'name': 'wait', 'type': 'Wait', 'parent': 'pick', 'scope': 'root.pick.default', 'depth': 1, 'branch': 'Default', 'deps': ''}]) as a from documents)"""


@query(
    "activity_tree",
    sql=f"with {_TREE_SQL} select doc_id, a.pos as pos, a.name as name, a.type as type, a.parent as parent, a.scope as scope, a.depth as depth, a.branch as branch, a.deps as deps from tree",
)
def activity_tree(spark, sf):
    t = nested(spark, sf).withColumn("deps", F.array_join(F.transform("depends_on", lambda d: d["activity"]), ","))
    return t.drop("depends_on", "definition")


@query(
    "activity_edges",
    sql=f"""
    with {_TREE_SQL}
    select doc_id, d as source, a.name as target, 'dependsOn' as edge_type, case when d = 'prep' then 'Failed' else 'Succeeded' end as condition
      from (select doc_id, a, unnest(string_split(a.deps, ',')) as d from tree where a.deps <> '')
    union all select doc_id, a.parent, a.name, 'container', a.branch from tree where a.parent is not null
    union all select doc_id, 'Look up', 'load_' || source, 'expression', 'activity_output_reference' from documents where doc_id % 2 = 0""",
)
def activity_edges(spark, sf):
    t = nested(spark, sf)
    e = t.where("type = 'ForEach'").select(
        "doc_id", F.col("name").alias("activity"), F.lit("typeProperties.items").alias("field_path"),
        F.get_json_object("definition", "$.typeProperties.items.value").alias("expression"),
    )
    return lin.activity_edges(t, "doc_id", e).withColumn("condition", F.array_join("condition", ","))


@query(
    "failure_handling",
    sql=f"""
    with {_TREE_SQL}
    select doc_id, a.name as name, case a.type when 'ForEach' then cast(doc_id % 3 as varchar) end as retry, case a.type when 'ForEach' then '1h' end as timeout,
      case a.name when 'copy' then 'prep' else '' end as after_failure_of, a.type in ('Office365Email', 'IfCondition') as notifies,
      a.name = 'audit' or a.type = 'IfCondition' as compensates from tree""",
)
def failure_handling(spark, sf):
    out = lin.failure_handling(nested(spark, sf), ["doc_id", "name"]).drop("retry_interval")
    return out.withColumn("after_failure_of", F.array_join("after_failure_of", ","))


@query(
    "flow_notifications",
    sql=f"""
    with {_TREE_SQL}
    select doc_id, a.name as name, 'ops@x.example.com' as recipients,
      case when doc_id % 4 = 0 then 'Failure alert' else 'Success/operational alert' end as trigger
    from tree where a.type in ('Office365Email', 'IfCondition')""",
)
def flow_notifications(spark, sf):
    out = lin.notifications(nested(spark, sf), ["doc_id", "name"])
    # an IfCondition holds its branches, so the words of both are in its text
    return out.withColumn("recipients", F.array_join("recipients", ","))


@query(
    "loop_kinds",
    sql="""
    select doc_id, 'load_' || source as name, case when doc_id % 2 = 0 then 'Metadata-driven ingestion loop' else 'Iterative loop' end as loop_type,
      case when doc_id % 2 = 0 then 'Look up' else 'Direct expression' end as iteration_source, 'Loop items' as iterated_entity from documents""",
)
def loop_kinds(spark, sf):
    return lin.loops(nested(spark, sf), ["doc_id", "name"])


@query(
    "notebook_layers",
    sql="""
    select doc_id, case when lang = 'en' then 'raw,gold' else '' end as layers,
      case when lang = 'en' then 'Medallion transformation toward raw -> gold' else 'Notebook transformation' end as intent from documents""",
)
def notebook_layers(spark, sf):
    return lin.notebook_layers(nested(spark, sf), ["doc_id"]).withColumn("layers", F.array_join("layers", ","))


@query(
    "ingestion_evidence",
    sql="""
    select doc_id, unnest(['REST API', 'JSON', 'Lakehouse']) as ingestion_type, unnest(['web', 'copy', 'copy']) as activity from documents""",
)
def ingestion_evidence(spark, sf):
    return cl.ingestion_evidence(nested(spark, sf), ["doc_id"], "pos")


@query(
    "flow_ingestion_types",
    sql=f"""
    with {_ACTS_SQL}, f as (select conv_id, bool_or(type = 'WebActivity') as a, bool_or(source_type is not null) as c, bool_or(sink_type = 'LakehouseTable') as lt,
      bool_or(sink_type = 'Parquet') as pq from acts group by conv_id)
    select conv_id, concat_ws('|', case when a then 'API' end, case when c then 'File-based' end, case when lt then 'Database' end) as ingestion_types,
      case when a or c then 'JSON' else '' end as input_types, case when pq then 'Parquet' else '' end as output_types from f""",
)
def flow_ingestion_types(spark, sf):
    a = activities(spark, sf).withColumn("definition", F.concat_ws(" ", "type", "sink_type"))
    out = cl.ingestion_types(a, ["conv_id"], "turn")
    return out.select("conv_id", *[F.array_join(c, "|").alias(c) for c in ("ingestion_types", "input_types", "output_types")])


# Candidate definitions of a language: the best by the words in its path and its number of steps.
_SCORE = (
    "case when contains(p, 'pipeline-content') then 5 else 0 end + case when contains(p, 'pipeline') then 2 else 0 end "
    "- case when contains(p, 'manifest') or contains(p, 'metadata') then 3 else 0 end + n_chars % 7"
)
_CAND = "case doc_id % 4 when 0 then 'x/Pipeline-content.json' when 1 then 'x/pipeline.json' when 2 then 'x/manifest.json' else 'x/pipeline_metadata.json' end"


@query(
    "best_definitions",
    sql=f"""
    with c as (select doc_id, source, n_chars, lower({_CAND}) as p from documents), s as (select *, {_SCORE} as score from c)
    select source, arg_min(doc_id, (-score, doc_id)) as doc_id, cast(max(score) as bigint) as score from s group by source""",
)
def best_definitions(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.expr(_CAND).alias("path"), (F.col("n_chars") % 7).alias("steps"))
    return lin.best_definition(d, ["source"], "path", "steps", "doc_id").select("source", "doc_id", F.col("score").cast("bigint").alias("score"))
