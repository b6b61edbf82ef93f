"""Landed API payloads (JSON text) as records and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.exploding import explode_map_once, posexplode_once

# Keys under which APIs wrap their records, in the order they are tried.
ENVELOPE_KEYS = (
    "data", "results", "items", "records", "value", "articles", "sources", "breeds", "countries", "hits", "entries",
    "response", "content", "list",
)


def records(payload: Column) -> Column:
    """array<string>: the payload's records as JSON objects.

    A list is its own records (of a pair [header, list], the list); an object gives its first wrapped list, else any
    list that is not empty, else itself.  A record that is no object becomes {"value": x}.
    """
    v = F.try_parse_json(payload)
    as_list = v.try_cast("array<variant>")
    second = F.get(as_list, F.lit(1)).try_cast("array<variant>")
    head_is_object = F.schema_of_variant(F.get(as_list, F.lit(0))).startswith("OBJECT")
    pair = (F.size(as_list) == 2) & second.isNotNull() & head_is_object
    members = F.from_json(payload, "map<string,variant>")  # keeps the order of the keys
    wrapped = [F.element_at(members, k).try_cast("array<variant>") for k in ENVELOPE_KEYS]
    lists = F.transform(F.map_values(members), lambda x: x.try_cast("array<variant>"))
    any_list = F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0))
    found = F.when(as_list.isNotNull(), F.when(pair, second).otherwise(as_list)).otherwise(F.coalesce(*wrapped, any_list))
    texts = F.transform(F.coalesce(found, F.array(v)), lambda r: F.to_json(r))
    return F.when(
        v.isNotNull(),
        F.transform(texts, lambda t: F.when(t.startswith("{"), t).otherwise(F.concat(F.lit('{"value":'), t, F.lit("}")))),
    )


def explode_records(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record: the kept columns, `pos` and `record`."""
    return posexplode_once(df, keep, records(F.col(payload)), "pos", "record")


def records_table(rows: DataFrame, record: str = "record", order: Sequence[str] = (), union_keys: bool = False) -> DataFrame:
    """Records as text columns: the keys of the first record (others are left out), or with `union_keys` of all."""
    keys = F.json_object_keys(record)
    if union_keys:
        names = [r[0] for r in rows.select(F.explode(keys)).distinct().orderBy("col").collect()]
    else:
        top = rows.orderBy(*order).select(keys).limit(1).collect() if order else rows.select(keys).limit(1).collect()
        names = list(top[0][0] or []) if top else []
    members = F.from_json(record, "map<string,variant>")

    def text(key: str) -> Column:
        member = F.element_at(F.col("_m"), key)
        return F.coalesce(member.try_cast("string"), F.to_json(member)).alias(key)

    kept = [c for c in rows.columns if c != record]
    return rows.withColumn("_m", members).select(*kept, *[text(n) for n in names])


def variant_type(v: Column) -> Column:
    """BOOLEAN, INTEGER, DOUBLE, JSON or STRING."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "BOOLEAN", "BOOLEAN").when(s == "BIGINT", "INTEGER")
        .when((s == "DOUBLE") | s.startswith("DECIMAL"), "DOUBLE")
        .when(s.startswith("OBJECT") | s.startswith("ARRAY"), "JSON").otherwise("STRING")
    )


def payload_schema(rows: DataFrame, record: str, order: Column, by: Sequence[str] = ()) -> DataFrame:
    """(column_name, data_type): the type each key has where it is first seen; suggested rules alongside."""
    members = explode_map_once(rows, [*by, order.alias("_o")], F.from_json(record, "map<string,variant>"), "column_name", "v")
    typed = members.select(*by, "column_name", F.struct(F.col("_o").alias("o"), variant_type(F.col("v")).alias("t")).alias("s"))
    first = typed.groupBy(*by, "column_name").agg(F.min("s")["t"].alias("data_type"))
    rules = F.when(F.col("data_type") == "JSON", F.array(F.lit("NOT_NULL"), F.lit("VALID_JSON"))).otherwise(F.array(F.lit("NOT_NULL")))
    return first.withColumn("dq_rules", rules).withColumn("severity", F.lit("WARN"))
