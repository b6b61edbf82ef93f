"""Lineage and dependency graphs as node and edge tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltworks.functions import labels as L
from siltworks.functions import paths
from siltworks.functions.text import contains_any, expression_references
from siltworks.operators.exploding import explode_once, posexplode_once
from siltworks.operators.keyed import by_shuffle, first_per_key
from siltworks.operators.scans import spread
from siltworks.session import ensure_checkpoint_dir


def node_type(urn: Column) -> Column:
    kind = F.regexp_extract(urn, r"^urn:li:(dataJob|dataFlow|dataset):", 1)
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("dataset"))


def lineage_nodes(items: DataFrame, order: str) -> DataFrame:
    """Nodes of (seed_urn, related_urn, edge_type) rows, each name once, the first mention wins."""
    o = F.col(order)
    mentions = items.select(F.col("seed_urn").alias("urn"), o.alias("_o"), F.lit(0).alias("_r")).unionByName(
        items.where("related_urn <> ''").select(F.col("related_urn").alias("urn"), o.alias("_o"), F.lit(1).alias("_r"))
    )
    first = mentions.groupBy("urn").agg(F.min(F.struct("_o", "_r")).alias("first_seen"))
    platform = F.coalesce(paths.parse_urn(F.col("urn"))["platform"], F.lit("unknown"))
    return first.select("urn", node_type(F.col("urn")).alias("node_type"), platform.alias("platform"))


def lineage_edges(items: DataFrame) -> DataFrame:
    """Edges from related to seed, unique on (source, target, type)."""
    return items.where("related_urn <> ''").select(
        F.col("related_urn").alias("source_urn"), F.col("seed_urn").alias("target_urn"),
        F.coalesce("edge_type", F.lit("DownstreamOf")).alias("edge_type"),
    ).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(urn, neighbour, ...node columns): one hop up or down; edges to unknown nodes are left out."""
    here, there = ("target_urn", "source_urn") if direction == "upstream" else ("source_urn", "target_urn")
    e = edges.select(F.col(here).alias("urn"), F.col(there).alias("neighbour"))
    n = nodes.select(F.col("urn").alias("neighbour"), "node_type", "platform")
    return e.join(n, "neighbour").select("urn", "neighbour", "node_type", "platform")


# Activity trees.

ACTIVITY_FIELDS = (
    "name string, type string, parent string, scope string, depth int, branch string, "
    "depends_on array<struct<activity:string,dependencyConditions:array<string>>>, definition string"
)


OUT_CHARS = 4_000_000


def activity_rows(definitions: DataFrame, key: str, activities: str) -> DataFrame:
    """(key, pos, name, type, parent, scope, depth, branch, depends_on, definition) of nested activity lists (JSON).

    Definitions nest to any depth, which no fixed chain of explodes covers, so each is walked in an Arrow batch;
    every definition is one row and stays in its task.  An activity's text holds those inside it, so rows leave whenever
    they hold `OUT_CHARS` characters: a task holds the texts of one definition and no more than that, however many come in a batch.
    """

    def named(a: dict, depth: int, index: int) -> str:
        return str(a.get("name") or a.get("type") or f"activity_{depth}_{index}")

    def inner(a: dict, name: str, scope: str) -> Iterator[tuple]:
        props = a.get("typeProperties")
        if not isinstance(props, dict):
            return
        yield props.get("activities"), f"{scope}.{name}", "ForEach"
        yield props.get("ifTrueActivities"), f"{scope}.{name}.ifTrue", "IfTrue"
        yield props.get("ifFalseActivities"), f"{scope}.{name}.ifFalse", "IfFalse"
        for i, case in enumerate(props.get("cases") or []):
            if isinstance(case, dict):
                yield case.get("activities"), f"{scope}.{name}.case{i}", str(case.get("value") or f"Case{i}")
        yield props.get("defaultActivities"), f"{scope}.{name}.default", "Default"

    def dependencies(a: dict) -> list[dict]:
        deps = a.get("dependsOn")
        out = []
        for d in deps if isinstance(deps, list) else []:
            target = d.get("activity") if isinstance(d, dict) else d
            if target:
                conditions = (d.get("dependencyConditions") if isinstance(d, dict) else None) or ["Succeeded"]
                out.append({"activity": str(target), "dependencyConditions": [str(c) for c in conditions]})
        return out

    def walk(text: str | None) -> list[tuple]:
        try:
            stack = [(json.loads(text), 0, None, "root", 0, None)]
        except (TypeError, ValueError):
            return []
        rows = []
        while stack:
            level, start, parent, scope, depth, branch = stack.pop()
            if not isinstance(level, list):
                continue
            for i, a in enumerate(level[start:], start):
                if isinstance(a, dict):
                    name = named(a, depth, i)
                    rows.append((len(rows), name, str(a.get("type") or "Unknown"), parent, scope, depth, branch, dependencies(a), json.dumps(a)))
                    nested = [(x, 0, name, s, depth + 1, b) for x, s, b in inner(a, name, scope)]
                    if any(isinstance(x[0], list) for x in nested):
                        # what follows on this level waits until the nested activities are listed
                        stack.append((level, i + 1, parent, scope, depth, branch))
                        stack.extend(reversed(nested))
                        break
        return rows

    columns = ["pos", "name", "type", "parent", "scope", "depth", "branch", "depends_on", "definition"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            held, size = [], 0
            for i in range(b.num_rows):
                for r in walk(texts[i].as_py()):
                    held.append((i, *r))
                    size += len(r[-1])
                    if size >= OUT_CHARS:
                        yield rows(keys, held)
                        held, size = [], 0
            if held:
                yield rows(keys, held)

    def rows(keys: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        at, *values = zip(*held, strict=True)
        filled = [pa.array(v, f.type) for v, f in zip(values, list(kinds)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *filled], names=[key, *columns])

    schema = T.StructType([T.StructField(key, definitions.schema[key].dataType), *T.StructType.fromDDL(f"pos int, {ACTIVITY_FIELDS}").fields])
    kinds = to_arrow_schema(schema)
    return spread(definitions.select(key, activities)).mapInArrow(explode, schema)


def activity_edges(activities: DataFrame, key: str, expressions: DataFrame | None = None) -> DataFrame:
    """(key, source, target, edge_type, condition): dependencies, containers and expression references."""

    def edge(source: Column, kind: str, condition: Column) -> Column:
        return F.struct(source.alias("source"), F.lit(kind).alias("edge_type"), condition.alias("condition"))

    depends = F.transform("depends_on", lambda d: edge(d["activity"], "dependsOn", d["dependencyConditions"]))
    inside = edge(F.col("parent"), "container", F.array(F.coalesce("branch", F.lit("Nested"))))
    both = F.concat(depends, F.filter(F.array(inside), lambda e: e["source"].isNotNull()))
    rows = explode_once(activities, [key, F.col("name").alias("target")], both, "e")
    out = rows.select(key, "e.source", "target", "e.edge_type", "e.condition")
    if expressions is not None:
        refs = expression_references(F.col("expression"))
        e = expressions.select(
            key, F.get(refs["activities"], F.lit(0)).alias("source"), F.col("activity").alias("target"),
            F.lit("expression").alias("edge_type"), F.array(refs["classification"]).alias("condition"), "field_path",
        )
        e = e.where("source is not null and source <> target").dropDuplicates([key, "source", "target", "field_path"])
        out = out.unionByName(e.drop("field_path"))
    return out


def roots(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, name) of nodes nothing points to."""
    targets = edges.select(key, F.col("target").alias("name")).distinct()
    return nodes.select(key, "name").distinct().join(targets, [key, "name"], "left_anti")


def terminals(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    sources = edges.select(key, F.col("source").alias("name")).distinct()
    return nodes.join(sources, [key, "name"], "left_anti")


def execution_paths(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, path array, fails): every way from a root to a node that leads nowhere new, each once.

    One join per step; finished paths leave the frontier, so later steps carry only what still grows.  No path visits
    a node twice, so the loop ends by itself.  Every step is checkpointed: a lost executor costs one step.
    A graph without a root starts at its first node by name.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    step = edges.where("source <> target").select(key, F.col("source").alias("_at"), F.col("target").alias("_next")).distinct()
    step = step.checkpoint()
    start = roots(nodes, edges, key)
    rootless = nodes.join(start.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min("name").alias("name"))
    frontier = start.unionByName(rootless).select(key, F.array("name").alias("path"), F.col("name").alias("_at"))
    done = None
    while True:
        grown = frontier.join(step, [key, "_at"], "left").withColumn(
            "_new", F.col("_next").isNotNull() & ~F.array_contains("path", F.coalesce("_next", F.lit("")))
        ).checkpoint()
        # a path is finished when none of its next nodes is new
        finished = grown.groupBy(key, "path").agg(F.bool_or("_new").alias("_grows")).where("not _grows").select(key, "path")
        done = finished if done is None else done.unionByName(finished)
        frontier = grown.where("_new").select(key, F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("_at"))
        if frontier.isEmpty():
            break
    fails = F.exists("path", lambda n: F.lower(n).contains("fail"))
    return done.distinct().withColumn("fails", fails)


def condensed(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, name, part) of the nodes on cycles, part being the least name of its cycle's nodes, and the edges between parts.

    Nodes that no cycle can hold are peeled off first: those that nothing still leads to, or that lead to nothing.  Only
    what stays is closed under reachability, by doubling, one checkpoint a round."""
    ensure_checkpoint_dir(edges.sparkSession)
    plain = edges.select(key, "source", "target").distinct().checkpoint()
    core = plain.where("source <> target").checkpoint()
    while True:
        inner = core.join(core.select(key, F.col("target").alias("source")).distinct(), [key, "source"], "left_semi")
        inner = inner.join(core.select(key, F.col("source").alias("target")).distinct(), [key, "target"], "left_semi").checkpoint()
        shrunk = inner.count() < core.count()
        core = inner.select(key, "source", "target")
        if not shrunk:
            break
    reach = core.checkpoint()
    while True:
        further = reach.withColumnRenamed("target", "_mid").join(reach.select(key, F.col("source").alias("_mid"), "target"), [key, "_mid"]).select(key, "source", "target")
        wider = reach.unionByName(further).distinct().checkpoint()
        if wider.count() == reach.count():
            break
        reach = wider
    back = reach.select(key, F.col("target").alias("source"), F.col("source").alias("target"))
    mutual = reach.join(back, [key, "source", "target"], "left_semi")
    parts = mutual.groupBy(key, F.col("source").alias("name")).agg(F.least(F.min("target"), F.col("source")).alias("part")).checkpoint()

    def renamed(df: DataFrame, column: str) -> DataFrame:
        own = parts.select(key, F.col("name").alias(column), F.col("part").alias("_part"))
        return df.join(own, [key, column], "left").withColumn(column, F.coalesce("_part", column)).drop("_part")

    between = renamed(renamed(plain, "source"), "target").where("source <> target").select(key, "source", "target").distinct()
    return parts, between.checkpoint()


def path_counts(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, root, end, fails, paths): how many ways lead from each root to each end, without listing one of them.

    A cycle counts as one node, under the least name in it; a way fails when the name of a node on it says so.  Step by step
    the number of ways that have come to a node is one row, added up over the nodes before it, so the work is that of
    the roots, nodes and steps, not of the ways.  Up to 38 digits.  In a graph without cycles these are the
    numbers of the ways that `execution_paths` lists."""
    parts, step = condensed(edges, key)
    named = nodes.select(key, "name").distinct().join(parts, [key, "name"], "left")
    fails = F.bool_or(F.lower("name").contains("fail"))
    merged = named.groupBy(key, F.coalesce("part", "name").alias("_at")).agg(fails.alias("_bad")).checkpoint()
    begins = merged.join(step.select(key, F.col("target").alias("_at")).distinct(), [key, "_at"], "left_anti")
    frontier = begins.select(key, F.col("_at").alias("root"), "_at", F.col("_bad").alias("fails"), F.lit(1).cast("decimal(38,0)").alias("paths")).checkpoint()
    going = step.join(merged.select(key, F.col("_at").alias("target"), "_bad"), [key, "target"]).select(key, F.col("source").alias("_at"), F.col("target").alias("_next"), "_bad").checkpoint()
    done = None
    while not frontier.isEmpty():
        ended = frontier.join(going.select(key, "_at").distinct(), [key, "_at"], "left_anti").select(key, "root", F.col("_at").alias("end"), "fails", "paths")
        done = ended if done is None else done.unionByName(ended)
        onward = frontier.join(going, [key, "_at"]).groupBy(key, "root", "_next", (F.col("fails") | F.col("_bad")).alias("fails"))
        frontier = onward.agg(F.sum("paths").cast("decimal(38,0)").alias("paths")).withColumnRenamed("_next", "_at").checkpoint()
    if done is None:
        done = frontier.select(key, "root", F.col("_at").alias("end"), "fails", "paths")
    return done.groupBy(key, "root", "end", "fails").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))


def dependency_order(nodes: DataFrame, edges: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name, level, sort_key, cyclic): the order in which activities can run.

    Sorting by (level, sort_key) gives the order within a graph: level 0 by name, later ones by the place of the parent that
    was done last, then by `order`.  A graph with a cycle keeps its input order (level null, sort_key by `order`).

    One round per level.  A level is sorted over all tasks and its rows are numbered as they lie, so a place is one long
    however deep the graph.  Settled nodes leave the next round's table; the edges they have served leave whenever the open
    nodes have halved, so a round reads at most about twice the edges that are still to be served.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    listed = nodes.select(key, "name", F.col(order).cast("bigint").alias("_ord"))
    known = nodes.select(key, F.col("name").alias("source")).distinct()
    waits = edges.join(known, [key, "source"], "left_semi").select(key, "source", F.col("target").alias("name")).checkpoint()
    degree = waits.groupBy(key, "name").agg(F.count(F.lit(1)).alias("_deg"))
    open_ = listed.join(degree, [key, "name"], "left").withColumn("_last", F.lit(None).cast("bigint")).checkpoint()

    def placed(df: DataFrame, *by: str) -> DataFrame:
        # numbers grow along the sorted partitions; name makes the order total
        return df.select(key, "name", "_ord", *[c for c in by if c == "_last"]).orderBy(key, *by, "name").select(
            key, "name", "_ord", F.monotonically_increasing_id().alias("sort_key")
        ).checkpoint()

    front = placed(open_.where("_deg is null"), "name", "_ord")
    open_ = open_.where("_deg is not null").checkpoint()
    settled, level, waiting = None, 0, open_.count()
    cut_at = waiting // 2
    while not front.isEmpty():
        done = front.select(key, "name", "_ord", F.lit(level).alias("level"), "sort_key")
        settled = done if settled is None else settled.unionByName(done)
        if not waiting:
            break
        at = front.select(key, F.col("name").alias("source"), F.col("sort_key").alias("_place"))
        served = at.join(waits, [key, "source"]).groupBy(key, "name").agg(F.count(F.lit(1)).alias("_n"), F.max("_place").alias("_at"))
        after = open_.join(served, [key, "name"], "left").select(
            key, "name", "_ord", (F.col("_deg") - F.coalesce("_n", F.lit(0))).alias("_deg"), F.col("_at").alias("_last")
        ).checkpoint()
        front = placed(after.where("_deg = 0"), "_last", "_ord")
        open_ = after.where("_deg > 0")
        waiting = open_.count()
        level += 1
        if waiting <= cut_at:
            cut_at = waiting // 2
            waits = waits.join(open_.select(key, "name").distinct(), [key, "name"], "left_semi").checkpoint()
    stuck = open_.select(key).distinct().withColumn("cyclic", F.lit(True)).checkpoint()
    left = open_.select(key, "name", "_ord", F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("sort_key"))
    out = (left if settled is None else settled.unionByName(left)).join(stuck, key, "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    return out.select(
        key, "name", F.when(~cyclic, F.col("level")).alias("level"), F.when(cyclic, F.col("_ord")).otherwise(F.col("sort_key")).alias("sort_key"),
        cyclic.alias("cyclic"),
    )


# What activities say about a flow.


def is_notification(kind: Column) -> Column:
    k = F.lower(kind)
    return k.isin(*L.NOTIFICATION_TYPES) | k.contains("email")


def is_validation(kind: Column) -> Column:
    return F.lower(kind).isin(*L.VALIDATION_TYPES)


def notifications(activities: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Activities that mail somebody: recipients, sorted, and what triggers them."""
    from siltworks.functions.text import emails

    low = F.lower("definition")
    rows = activities.where(low.contains("mail"))
    trigger = F.when(low.contains("fail"), "Failure alert").otherwise("Success/operational alert")
    return rows.select(*keep, emails(F.col("definition")).alias("recipients"), trigger.alias("trigger"))


def failure_handling(activities: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Per activity: retry policy, failure conditions it waits for, and whether it notifies or compensates."""
    low = F.lower("definition")

    def policy(name: str) -> Column:
        return F.get_json_object("definition", f"$.policy.{name}")

    on_failure = F.filter("depends_on", lambda d: F.exists(d["dependencyConditions"], lambda c: F.lower(c).contains("fail")))
    return activities.select(
        *keep,
        policy("retry").alias("retry"),
        policy("retryIntervalInSeconds").alias("retry_interval"),
        policy("timeout").alias("timeout"),
        F.transform(on_failure, lambda d: d["activity"]).alias("after_failure_of"),
        low.contains("mail").alias("notifies"),
        contains_any(low, ("rollback", "compensat", "audit", "status")).alias("compensates"),
    )


def flow_text(activities: DataFrame, by: str, order: Sequence[str], source: Column, destination: Column, has_rules: Column) -> DataFrame:
    """`source -> step -> step -> sink` per definition, without its notification steps.

    The text holds every step of its definition, so it is as long as the definition itself."""
    visible = F.when(~is_notification(F.col("type")), F.struct(*order, "name"))
    steps = activities.groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(visible)), lambda s: s["name"]).alias("_steps"),
        F.max(source).alias("_source"), F.max(destination).alias("_sink"), F.bool_or(has_rules).alias("_rules"),
    )
    middle = F.when(F.size("_steps") > 0, F.array_join("_steps", " -> ")).otherwise(F.col(by).cast("string"))
    gates = F.when(F.col("_rules"), " with validation gates").otherwise("")
    text = F.concat(
        F.coalesce("_source", F.lit("No explicit source")), F.lit(" -> "), middle, F.lit(" -> "),
        F.coalesce("_sink", F.lit("no explicit sink")), gates,
    )
    return steps.select(by, text.alias("flow"))


def destinations(activities: DataFrame, edges: DataFrame, by: str, order: str) -> DataFrame:
    """(key, name, why): where a definition ends up.

    Terminal activities with a sink (or a notebook), else the last activity that has one, else terminal process
    steps.  Notifications never count.  `sink` is the activity's sink label, null where it has none.
    """
    ends = terminals(activities, edges, by).select(by, "name").withColumn("_end", F.lit(True))
    rows = activities.where(~is_notification(F.col("type"))).join(ends, [by, "name"], "left")
    label = F.coalesce("sink", F.when(F.lower("type").isin(*L.NOTEBOOK_TYPES), F.col("name")))
    end = F.coalesce("_end", F.lit(False))
    rank = F.when(end & label.isNotNull(), 1).when(label.isNotNull(), 2).when(end & ~is_validation(F.col("type")), 3)
    rows = rows.select(by, F.coalesce(label, F.col("name")).alias("name"), F.col(order).alias("_o"), rank.alias("_rank")).where("_rank is not null")
    best = rows.groupBy(by).agg(F.min("_rank").alias("_rank"), F.max(F.when(F.col("_rank") == 2, F.col("_o"))).alias("_last"))
    why = F.element_at(F.create_map(F.lit(1), F.lit("terminal sink"), F.lit(2), F.lit("last sink"), F.lit(3), F.lit("terminal step")), F.col("_rank"))
    return rows.join(best, [by, "_rank"]).where((F.col("_rank") != 2) | (F.col("_o") == F.col("_last"))).select(by, "name", why.alias("why"))


def stages(activities: DataFrame, by: str, order: str) -> DataFrame:
    """(key, stage, label, first): SOURCE, STAGING, TRANSFORMATION and DESTINATION entries, each once.

    `source_type`/`sink_type` are dataset types, `source`/`sink` their labels."""
    kind = F.lower("type")
    sink = F.lower(F.coalesce("sink_type", F.lit("")))
    src = F.lower(F.coalesce("source_type", F.lit("")))

    def entry(rank: int, stage: str, when: Column, label: Column) -> Column:
        return F.when(when & label.isNotNull(), F.struct(F.lit(rank).alias("rank"), F.lit(stage).alias("stage"), label.alias("label")))

    has_source = contains_any(src, L.FILE_DATASET_TOKENS) | contains_any(src, L.DATABASE_DATASET_TOKENS)
    entries = F.array_compact(F.array(
        entry(0, "SOURCE", has_source, F.col("source")),
        entry(1, "SOURCE", kind == "webactivity", F.col("name")),
        entry(1, "STAGING", contains_any(sink, L.FILE_DATASET_TOKENS), F.col("sink")),
        entry(1, "TRANSFORMATION", kind.isin(*L.TRANSFORM_TYPES), F.col("name")),
        entry(1, "DESTINATION", contains_any(sink, L.DATABASE_DATASET_TOKENS), F.col("sink")),
    ))
    rows = posexplode_once(activities, [by, F.col(order).alias("_o")], entries, "_p", "e")
    return rows.groupBy(by, F.col("e.stage").alias("stage"), F.col("e.label").alias("label")).agg(
        F.min(F.struct(F.col("e.rank").alias("r"), F.col("_o").alias("o"), F.col("_p").alias("p"))).alias("first")
    )


def stage_flow(activities: DataFrame, by: str, order: str) -> DataFrame:
    """The stages of a definition as one text, in order."""
    entries = stages(activities, by, order).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("first", "stage", "label"))).alias("s"))
    return entries.select(by, F.array_join(F.transform("s", lambda x: F.concat(x["stage"], F.lit(": "), x["label"])), " -> ").alias("flow"))


def loops(activities: DataFrame, keep: Sequence[str]) -> DataFrame:
    """ForEach activities: what they iterate over."""
    items = F.coalesce(F.get_json_object("definition", "$.typeProperties.items.value"), F.get_json_object("definition", "$.typeProperties.items"), F.lit(""))
    refs = expression_references(items)
    source = F.get(refs["activities"], F.lit(0))
    driven = source.isNotNull() | (F.size(refs["item_fields"]) > 0)
    named = F.exists(refs["item_fields"], lambda f: F.lower(f).isin("tablename", "baseurl", "entity", "source"))
    return activities.where(F.lower("type") == "foreach").select(
        *keep,
        F.when(driven, "Metadata-driven ingestion loop").otherwise("Iterative loop").alias("loop_type"),
        F.coalesce(source, F.lit("Direct expression")).alias("iteration_source"),
        F.when(named, "Configured source systems").otherwise("Loop items").alias("iterated_entity"),
    )


def notebook_layers(activities: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Notebook activities and the layers their parameters name."""
    params = F.lower(F.coalesce(F.get_json_object("definition", "$.typeProperties.parameters"), F.lit("{}")))
    layers = F.array_compact(F.array(*[F.when(params.contains(t), F.lit(t)) for t in L.LAYER_TOKENS]))
    intent = F.when(F.size(layers) > 0, F.concat(F.lit("Medallion transformation toward "), F.array_join(layers, " -> "))).otherwise("Notebook transformation")
    return activities.where(F.lower("type").contains("notebook")).select(*keep, layers.alias("layers"), intent.alias("intent"))


def _plain_name(c: str) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.col(c))), r"_?\d+$", "")


def _bag(colour: Column, *, name: str) -> list[Column]:
    """Aggregates that say which colours a group holds and how often, whatever their order: a count and two sums.

    They combine map-side, so a node with very many neighbours, or a very large graph, is never collected."""
    halves = [F.conv(F.substring(colour, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    return [F.count(colour).alias(f"{name}n"), *[F.sum(h).alias(f"{name}{i}") for i, h in enumerate(halves)]]


def refined_colours(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, name, colour): nodes have one colour when nothing about their surroundings tells them apart.

    The first colour of a node is its plain name and type; each round adds the colours of the nodes before and after it,
    until no round tells more nodes apart.  Names only say which nodes an edge joins; their numbers do not count.  An end of an edge that is no
    node is one without a type.  As ever with this method, graphs in which all nodes look alike (one ring of six, two rings of three) stay equal."""
    ensure_checkpoint_dir(nodes.sparkSession)
    wires = edges.select(key, "source", "target").checkpoint()
    label = F.md5(F.concat(_plain_name("name"), F.lit("::"), F.coalesce(F.trim(F.lower("type")), F.lit(""))))
    ends = wires.select(key, F.col("source").alias("name")).unionByName(wires.select(key, F.col("target").alias("name"))).distinct()
    ends = ends.join(by_shuffle(nodes.select(key, "name").distinct()), [key, "name"], "left_anti").withColumn("type", F.lit(None).cast("string"))
    every = nodes.select(key, "name", F.col("type").cast("string").alias("type")).unionByName(ends)
    parts = ("n", "0", "1")

    def mixed(*names: str) -> Column:
        return F.md5(F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names]))

    colours = every.groupBy(key, "name").agg(*_bag(label, name="_l")).select(key, "name", mixed(*[f"_l{p}" for p in parts]).alias("colour")).checkpoint()
    classes = colours.select("colour").distinct().count()
    while True:
        before = wires.join(by_shuffle(colours.withColumnRenamed("name", "source")), [key, "source"]).select(key, F.col("target").alias("name"), F.col("colour").alias("_b"), F.lit(None).cast("string").alias("_a"))
        after = wires.join(by_shuffle(colours.withColumnRenamed("name", "target")), [key, "target"]).select(key, F.col("source").alias("name"), F.lit(None).cast("string").alias("_b"), F.col("colour").alias("_a"))
        around = before.unionByName(after).groupBy(key, "name").agg(*_bag(F.col("_b"), name="_b"), *_bag(F.col("_a"), name="_a"))
        told = colours.join(by_shuffle(around), [key, "name"], "left").select(key, "name", mixed("colour", *[f"_{s}{p}" for s in "ba" for p in parts]).alias("colour")).checkpoint()
        more = told.select("colour").distinct().count()
        if more == classes:
            return colours
        colours, classes = told, more


# What ends a name without counting: `_plain_name` in Python.  In Java $ also stands before a line break that ends the text.
_NUMBER = re.compile("_?[0-9]+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")
LARGE = 100_000  # nodes and edges of a graph that one task may take whole
BUCKET_ROWS = 400_000  # nodes and edges, of many graphs, that one task looks at together
PACK_ROWS = 500_000  # nodes and edges that a task deals out together


def _label(name: str, kind: str) -> bytes:
    return hashlib.blake2b(f"{_NUMBER.sub('', name.lower().strip(' '))}::{kind}".encode(), digest_size=16).digest()


def _stirred(h: np.ndarray, w: np.ndarray, lane: int) -> np.ndarray:
    h = (h ^ (w + np.uint64(lane))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _summed(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, at, values)
    return out


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of nodes and edges as one text of bytes per bucket, a few hundred thousand rows at a time."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(t["bucket"].to_numpy(), kind="stable")
        cuts = np.searchsorted(t["bucket"].to_numpy()[order], np.arange(buckets + 1))
        t, full, out = t.drop_columns(["bucket"]).take(order), np.flatnonzero(np.diff(cuts)), []
        for i in full.tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as writer:
                writer.write_table(t.slice(int(cuts[i]), int(cuts[i + 1] - cuts[i])))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(out, pa.binary())], names=["bucket", "rows"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _bags(packed: pa.Table) -> pa.Table:
    """(_k, r, n, s0, s1) for each graph: the round that tells no more of its nodes apart, and the bag of that round's colours.

    A graph's colours are those of `refined_colours`, but every graph stops by itself.  Two graphs whose last rounds have equal
    numbers and equal bags have equal bags for ever: a colour holds the one before, so in both the same colours follow each other."""
    t = pa.concat_tables([pa.ipc.open_stream(x.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)).read_all() for x in packed["rows"]]).combine_chunks()
    keys = t["_k"].combine_chunks().dictionary_encode()
    graph, node = keys.indices.to_numpy().astype(np.int64), t["node"].to_numpy()
    a, b = t["a"].combine_chunks(), t["b"].combine_chunks()
    wire = np.flatnonzero(~node)
    names = pa.concat_arrays([a, b.take(wire)]).dictionary_encode()
    code = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)  # a null comes after all names
    ids, vertex = np.unique(np.concatenate([graph, graph[wire]]) * (len(names.dictionary) + 1) + code, return_inverse=True)
    graph, code = np.divmod(ids, len(names.dictionary) + 1)  # of each vertex, by graph
    named = code < len(names.dictionary)

    kinds = b.filter(pa.array(node)).dictionary_encode()
    texts = ["", *(x.lower().strip(" ") for x in kinds.dictionary.to_pylist())]
    kind = kinds.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    own = vertex[: len(node)][node]
    bare = np.ones(len(ids), bool)  # an end of an edge that is no node is one without a type
    bare[own] = False
    bare = np.flatnonzero(bare & named)
    own, kind = own[named[own]], kind[named[own]]
    pairs, pair = np.unique(np.concatenate([code[own] * len(texts) + kind, code[bare] * len(texts)]), return_inverse=True)
    said = names.dictionary.to_pylist()
    labels = np.frombuffer(b"".join(_label(said[p // len(texts)], texts[p % len(texts)]) for p in pairs.tolist()), np.uint64).reshape(-1, 2)
    own = np.concatenate([own, bare])
    count = np.bincount(own, minlength=len(ids)).astype(np.uint64)
    colour = [_stirred(_summed(labels[pair, lane], own, len(ids)), count, lane) for lane in (0, 1)]

    # an edge with a null end joins nothing
    source, target = vertex[: len(node)][wire], vertex[len(node) :]
    both = named[source] & named[target]
    source, target = source[both], target[both]
    degree = np.bincount(target, minlength=len(ids)).astype(np.uint64) << np.uint64(32) | np.bincount(source, minlength=len(ids)).astype(np.uint64)
    out = np.zeros((4, len(keys.dictionary)), np.uint64)
    which = np.arange(len(keys.dictionary))  # the graphs that go on

    def classes() -> np.ndarray:
        bits = np.uint64(max(1, len(which).bit_length()))
        marked = np.sort(graph.astype(np.uint64) << (np.uint64(64) - bits) | colour[0] >> bits)
        return np.add.reduceat(np.concatenate([[True], marked[1:] != marked[:-1]]), starts, dtype=np.int64)

    starts = np.searchsorted(graph, which)
    told, r = classes(), 0
    while len(which):
        r += 1
        colour = [
            _stirred(_stirred(_stirred(c, degree, lane), _summed(c[source], target, len(c)), lane), _summed(c[target], source, len(c)), lane)
            for lane, c in enumerate(colour)
        ]
        more = classes()
        ends = more == told
        if not ends.any():
            told = more
            continue
        size = np.diff(np.append(starts, len(graph)))
        for i, x in enumerate([np.full(len(which), r), size, *(np.add.reduceat(c, starts) for c in colour)]):
            out[i, which[ends]] = x[ends]
        # the others go on without the graphs that are done
        stay = ~ends[graph]
        number = np.cumsum(stay) - 1
        held = stay[source]
        source, target = number[source[held]], number[target[held]]
        graph, degree, colour = (np.cumsum(~ends) - 1)[graph[stay]], degree[stay], [c[stay] for c in colour]
        which, told = which[~ends], more[~ends]
        starts = np.searchsorted(graph, np.arange(len(which)))
    return pa.Table.from_arrays([keys.dictionary, *(pa.array(x.view(np.int64)) for x in out)], names=["_k", "r", "n", "s0", "s1"])


def _large_graphs(every: DataFrame) -> tuple[DataFrame | None, int]:
    """(_k) of the graphs that no task is to take whole, and of a null key, whose nodes no edge joins, if there are any; the number of all rows.

    Graphs of equal colours are of equal size here: labels and edges that join two nodes."""
    counts = every.groupBy("_k").count()
    nulls = F.count_if(F.col("_k").isNull())
    n, most, nulls = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)), nulls).first()
    if most <= LARGE // 4 and not nulls:
        return None, n
    some = counts.where((F.col("count") > LARGE // 4) | F.col("_k").isNull()).select("_k").checkpoint()
    rows = every.join(F.broadcast(some), "_k")
    wires = rows.where("not node")
    ends = wires.select("_k", "a").union(wires.select("_k", "b")).where("a is not null").distinct()
    own = rows.where("node and a is not null").select("_k", "a")
    ends = ends.join(by_shuffle(own.distinct()), ["_k", "a"], "left_anti")
    sizes = own.union(ends).select("_k").union(wires.where("a is not null and b is not null").select("_k")).groupBy("_k").count()
    return sizes.where(F.col("count") > LARGE).select("_k").union(some.where("_k is null")).checkpoint(), n


def structure_bags(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, _c): a text that is equal for graphs that `refined_colours` colours alike.

    Graphs are dealt out whole, many to a task; what is too large for that is coloured as a table."""
    ensure_checkpoint_dir(nodes.sparkSession)
    every = nodes.select(F.col(key).alias("_k"), F.lit(True).alias("node"), F.col("name").alias("a"), F.col("type").cast("string").alias("b")).unionByName(
        edges.select(F.col(key).alias("_k"), F.lit(False).alias("node"), F.col("source").alias("a"), F.col("target").alias("b"))
    )
    large, n = _large_graphs(every)
    small = every if large is None else every.join(F.broadcast(large), "_k", "left_anti").where("_k is not null")
    buckets = max(1, n // BUCKET_ROWS)
    packed = small.withColumn("bucket", F.pmod(F.xxhash64("_k"), F.lit(buckets)).cast("int")).mapInArrow(lambda batches: _packed(batches, buckets), "bucket int, rows binary")
    schema = T.StructType([every.schema["_k"], *(T.StructField(c, T.LongType()) for c in ("r", "n", "s0", "s1"))])
    bags = packed.groupBy("bucket").applyInArrow(_bags, schema).select(F.col("_k").alias(key), F.concat_ws("|", "r", "n", "s0", "s1").alias("_c"))
    if large is None:
        return bags
    known = F.broadcast(large.select(F.col("_k").alias("_lk")))
    apart = [df.join(known, F.col(key).eqNullSafe(F.col("_lk")), "left_semi") for df in (nodes, edges)]
    whole = refined_colours(*apart, key).groupBy(key).agg(*_bag(F.col("colour"), name="_c"))
    return bags.unionByName(whole.select(key, F.concat_ws("|", F.lit("large"), *[F.col(f"_c{p}").cast("string") for p in ("n", "0", "1")]).alias("_c")))


def graph_signature(nodes: DataFrame, edges: DataFrame, key: str, flow: DataFrame) -> DataFrame:
    """(key, signature): equal for definitions of equal structure (by `structure_bags`) and equal flow text.

    Copies whose activities only bear other numbers are equal; the same activities wired otherwise are not."""
    text = flow.select(key, F.sha2(F.trim(F.lower("flow")), 256).alias("_f"))
    whole = by_shuffle(structure_bags(nodes, edges, key)).join(by_shuffle(text), key, "left")
    return whole.select(key, F.sha2(F.concat_ws("|", "_c", F.coalesce("_f", F.lit("-"))), 256).alias("signature"))


def first_of_structure(signatures: DataFrame, key: str) -> DataFrame:
    """One definition per structure, the first by key."""
    return first_per_key(signatures, ["signature"], [F.asc(key)])


def best_definition(candidates: DataFrame, by: Sequence[str], path: str, steps: str, order: str) -> DataFrame:
    """The best candidate file per group: by the words in its path and its number of steps, then by `order`."""
    p = F.lower(path)
    score = (
        F.when(p.contains("pipeline-content"), 5).otherwise(0)
        + F.when(p.contains("pipeline"), 2).otherwise(0)
        - F.when(p.contains("manifest") | p.contains("metadata"), 3).otherwise(0)
        + F.col(steps)
    )
    return first_per_key(candidates.withColumn("score", score), list(by), [F.desc("score"), F.asc(order)])
