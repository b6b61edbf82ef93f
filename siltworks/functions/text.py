"""Columns that read facts out of free text, SQL strings, expressions and JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contains_any(text: Column, tokens: Sequence[str]) -> Column:
    out = text.contains(tokens[0])
    for t in tokens[1:]:
        out = out | text.contains(t)
    return out


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def emails(text: Column) -> Column:
    """Addresses in a text, sorted, each once."""
    return F.array_sort(F.array_distinct(find_all(text, r"(?U)[\w\.-]+@[\w\.-]+\.\w+")))


def distinct_texts(values: Column) -> Column:
    """Non-empty texts in first-seen order, each once."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def drop_empty(values: Column) -> Column:
    """A map without null or empty values."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


# A JSON string with its quotes; control characters never stand in JSON as they are, so one can mark a place.
_JSON_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MARK = "\x01"


def key_values(text: Column, key: str) -> Column:
    """array<string>: JSON texts of all values of a key, whatever its case, at any depth, in the order of the text.

    The text is written anew without blanks, every key in it marked (strings are read whole, so nothing inside one is
    taken for a key) and cut before each key that is wanted; what follows the key is its value.  Only a value that holds
    the key again is read from a longer piece.  Null for texts that are no JSON, or nest deeper than Spark's JSON
    reader goes (1,000 levels)."""
    name = json.dumps(key, ensure_ascii=False)
    wanted = rf"{_MARK}(?iu)\Q{name}\E:"
    compact = F.get_json_object(text, "$")
    marked = F.replace(
        F.regexp_replace(compact, f"({_JSON_TEXT}):|({_JSON_TEXT})", f"{_MARK}$1:$2"), F.lit(f"{_MARK}:"), F.lit("")
    )
    pieces = F.split(marked, f"(?={wanted})", -1)

    def value(piece: Column, rest: Column) -> Column:
        bare = F.replace(F.substr(piece, F.lit(len(name) + 3)), F.lit(_MARK), F.lit(""))
        longer = F.replace(F.substr(rest, F.lit(len(name) + 3)), F.lit(_MARK), F.lit(""))
        nested = F.coalesce(F.get_json_object(bare, "$"), F.get_json_object(longer, "$"))
        return (
            F.when(bare.startswith('"'), F.regexp_extract(bare, f"^{_JSON_TEXT}", 0))
            .when(bare.startswith("{") | bare.startswith("["), nested)
            .otherwise(F.regexp_extract(bare, r"^[^,}\]]+", 0))
        )

    def all_values(p: Column) -> Column:
        return F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: value(x, F.array_join(F.slice(p, i + 2, F.size(p)), "")))

    found = F.element_at(F.transform(F.array(pieces), all_values), 1)
    nothing = F.array().cast("array<string>")
    return F.when(compact.isNotNull() | (F.trim(text) == "null"), F.when(F.ltrim(text).rlike(r"^\s*[\[{]"), found).otherwise(nothing))


def first_key_value(text: Column, keys: Sequence[str]) -> Column:
    """The first value of the first key that occurs."""
    return F.coalesce(*[F.get(key_values(text, k), F.lit(0)) for k in keys])


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested struct fields as columns with dotted names."""

    def leaves(schema: T.StructType, prefix: tuple[str, ...]):
        for f in schema.fields:
            path = prefix + (f.name,)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


def sql_tables(sql: Column) -> Column:
    return find_all(sql, r"(?i)(?:from|join)\s+([A-Za-z0-9_\.\[\]]+)", 1)


def sql_filter(sql: Column) -> Column:
    return F.trim(F.regexp_extract(sql, r"(?is)\bwhere\b\s+(.+?)(?:\border\b|\bgroup\b|$)", 1))


# SQL as tokens: blanks with comments, strings, names with their dots and quotes, single characters.
_SQL_PART = r"""(?:[\w@#$]+|\[[^\]]*\]|"[^"]*"|`[^`]*`)"""
_SQL_TOKEN = rf"""(?U)(?:\s++|--[^\n]*+|/\*(?s:.*?)\*/)++|'[^']*+(?:''[^']*+)*+'|{_SQL_PART}(?:\.{_SQL_PART})*|\S"""
_CLAUSE_ENDS = (
    "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "QUALIFY", "SET", "VALUES", "FETCH", "OFFSET", ";",
)
_SCAN = "struct<levels:array<int>,tables:array<string>,ctes:array<string>,before:string,expects:boolean,named:boolean,start:int,stop:int>"
_SELECTS, _IN_FROM, _IN_WITH = 1, 2, 4  # what is known of a level of parentheses


def sql_scan(sql: Column) -> Column:
    """struct<tables array<string>, filter string>: the tables a statement reads, as written, and its outermost condition.

    One pass over the tokens carries the open parentheses, so FROM counts only in a query (not in `extract(year from d)` or `is
    distinct from`), commas in a FROM list name further tables, and derived tables, table functions and names that WITH
    defines are no tables.  Comments and strings say nothing.  The condition is that of the first statement with a WHERE outside
    parentheses, blanks and comments as single blanks; empty where there is none.  Null for null."""

    def blank(t: Column) -> Column:
        return t.rlike(r"(?Us)^(?:\s|--|/\*.*\*/)")

    def read(word: Column) -> Column:
        """What a token is by itself, found once and not at each use in a step."""
        t, u = word["t"], word["u"]
        ends, passes = u.isin(*_CLAUSE_ENDS), u.isin("LATERAL", "ONLY", "RECURSIVE")
        is_name = t.rlike(r"""(?U)^[\w@#$\["`]""") & ~t.rlike("^[0-9]") & ~ends & ~passes & ~u.isin("SELECT", "FROM", "WITH")
        return F.struct(t.alias("t"), u.alias("u"), word["i"].alias("i"), ends.alias("ends"), passes.alias("passes"), is_name.alias("is_name"))

    texts = "array<string>"
    start = F.struct(
        F.array(F.lit(0)).alias("levels"), F.array().cast(texts).alias("tables"), F.array().cast(texts).alias("ctes"), F.lit(";").alias("before"),
        F.lit(False).alias("expects"), F.lit(False).alias("named"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
    ).cast(_SCAN)

    def step(s: Column, w: Column) -> Column:
        t, u, ends, passes, is_name = (w[c] for c in ("t", "u", "ends", "passes", "is_name"))
        levels, top, depth = s["levels"], F.element_at(s["levels"], -1), F.size(s["levels"])

        def has(bit: int) -> Column:
            return top.bitwiseAND(F.lit(bit)) != 0

        reads = (u == "FROM") & has(_SELECTS) & (s["before"] != "DISTINCT")
        joins = (u == "JOIN") & has(_IN_FROM)
        lists = (u == ",") & has(_IN_FROM)
        table = s["expects"] & is_name
        defines = has(_IN_WITH) & ~has(_SELECTS) & is_name & s["before"].isin("WITH", "RECURSIVE", ",")
        begins_with = (u == "WITH") & ~has(_SELECTS)
        new_top = (
            F.when(u == "SELECT", F.lit(_SELECTS))
            .when(u == "DELETE", top.bitwiseOR(F.lit(_SELECTS)))
            .when(reads, top.bitwiseOR(F.lit(_IN_FROM)))
            .when(begins_with, top.bitwiseOR(F.lit(_IN_WITH)))
            .when(ends, top.bitwiseAND(F.lit(_SELECTS | _IN_WITH)))
            .otherwise(top)
        )
        below = F.slice(levels, 1, depth - 1)
        new_levels = (
            # a parenthesis where a table is expected holds a join or a query
            F.when(t == "(", F.concat(levels, F.array(F.when(s["expects"], F.lit(_IN_FROM)).otherwise(F.lit(0)))))
            .when((t == ")") & (depth > 1), below)
            .when(t == ";", F.array(F.lit(0)))
            .when(new_top != top, F.concat(below, F.array(new_top)))
            .otherwise(levels)
        )
        called = (t == "(") & s["named"]
        tables = F.when(table, F.concat(s["tables"], F.array(t))).when(called, F.slice(s["tables"], 1, F.size(s["tables"]) - 1)).otherwise(s["tables"])
        outside = depth == 1
        return F.struct(
            new_levels.alias("levels"), tables.alias("tables"),
            F.when(defines, F.concat(s["ctes"], F.array(F.lower(t)))).otherwise(s["ctes"]).alias("ctes"), u.alias("before"),
            (reads | joins | lists | ((passes | (t == "(")) & s["expects"])).alias("expects"), table.alias("named"),
            F.coalesce(s["start"], F.when(outside & (u == "WHERE"), w["i"] + 1)).alias("start"),
            F.coalesce(s["stop"], F.when(outside & ends & s["start"].isNotNull(), w["i"])).alias("stop"),
        ).cast(_SCAN)

    def result(tokens: Column, s: Column) -> Column:
        stop = F.coalesce(s["stop"], F.size(tokens))
        shown = F.transform(F.slice(tokens, s["start"] + 1, stop - s["start"]), lambda t: F.when(blank(t), F.lit(" ")).otherwise(t))
        condition = F.trim(F.array_join(shown, ""))
        return F.struct(
            F.filter(s["tables"], lambda t: ~F.array_contains(s["ctes"], F.lower(t))).alias("tables"),
            F.coalesce(condition, F.lit("")).alias("filter"),
        )

    def scan(tokens: Column) -> Column:
        words = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.upper(t).alias("u"), i.alias("i"))), lambda w: ~blank(w["t"]))
        return F.aggregate(F.transform(words, read), start, step, lambda s: result(tokens, s))

    # an array of one element names the tokens, so that the statement is cut once
    return F.when(sql.isNotNull(), F.get(F.transform(F.array(find_all(sql, _SQL_TOKEN)), scan), F.lit(0)))


def sql_reading(df: DataFrame, sql: str) -> DataFrame:
    """Tables, condition and purpose of a column of SQL statements, by `sql_scan`; `sql_analysis` is for texts that only mention SQL."""
    s = F.col(sql)
    read = df.withColumn("_scan", sql_scan(s))
    tables = F.col("_scan.tables")
    return read.withColumns({
        "tables": tables, "config_table": F.coalesce(F.get(tables, F.lit(0)), F.lit("UNKNOWN")), "filter_logic": F.col("_scan.filter"),
        "purpose": purpose_of(tables, s),
    }).drop("_scan")


def purpose_of(tables: Column, sql: Column) -> Column:
    """What a statement is for, by the name of its first table and its words."""
    table = F.lower(F.coalesce(F.get(tables, F.lit(0)), F.lit("")))
    return (
        F.when(contains_any(table, ("config", "control", "metadata")), "Metadata-driven ingestion controller")
        .when(contains_any(table, ("audit", "status", "log")), "Audit/status tracking")
        .when(contains_any(F.lower(sql), ("watermark", "incremental")), "Incremental load control")
        .otherwise("Operational SQL")
    )


def sql_analysis(df: DataFrame, sql: str) -> DataFrame:
    s = F.col(sql)
    return df.where(F.lower(s).contains("select")).withColumns({
        "tables": sql_tables(s),
        "config_table": F.coalesce(F.get(sql_tables(s), F.lit(0)), F.lit("UNKNOWN")),
        "filter_logic": sql_filter(s),
        "purpose": purpose_of(sql_tables(s), s),
    })


def expression_references(e: Column) -> dict[str, Column]:
    """What a dynamic expression refers to, and its class."""
    lowered = F.lower(e)
    functions = F.array_sort(F.array_distinct(F.transform(find_all(e, r"@?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1), F.lower)))
    activities = find_all(e, r"(?i)activity\('([^']+)'\)", 1)
    variables = find_all(e, r"(?i)variables\('([^']+)'\)", 1)
    parameters = F.array_union(
        find_all(e, r"(?i)parameters\('([^']+)'\)", 1), find_all(e, r"(?i)pipeline\(\)\.parameters\.([A-Za-z0-9_]+)", 1)
    )
    fields = find_all(e, r"(?i)item\(\)\.([A-Za-z0-9_]+)", 1)
    builders = F.array(*[F.lit(f) for f in ("concat", "replace", "substring", "formatdatetime")])
    kind = (
        F.when(F.size(activities) > 0, "activity_output_reference")
        .when(F.size(fields) > 0, "foreach_item_reference")
        .when(F.size(variables) > 0, "variable_reference")
        .when(F.size(parameters) > 0, "parameter_reference")
        .when(F.arrays_overlap(functions, builders), "dynamic_value_builder")
        .when(lowered.contains("equals(") | lowered.contains("if("), "branch_condition")
        .otherwise("runtime_expression")
    )
    return {
        "functions": functions,
        "activities": activities,
        "variables": variables,
        "parameters": F.array_sort(parameters),
        "item_fields": fields,
        "table_fields": F.filter(fields, lambda f: contains_any(F.lower(f), ("table", "entity"))),
        "file_fields": F.filter(fields, lambda f: contains_any(F.lower(f), ("file", "path", "folder", "name"))),
        "classification": kind,
    }


# Fixed formats of storage and connection addresses.
_TAIL = r"""[^\s"'>,]+"""


def storage_paths(text: Column) -> dict[str, Column]:
    return {
        "s3_paths": find_all(text, rf"(?i)s3[an]?://{_TAIL}"),
        "adls_paths": find_all(text, rf"(?i)abfss?://{_TAIL}"),
        "gcs_paths": find_all(text, rf"(?i)gs://{_TAIL}"),
    }


def connection_parts(text: Column) -> dict[str, Column]:
    """Buckets, containers, JDBC addresses, topics and API addresses named in a text."""
    redshift = first_match(text, rf"(?i)jdbc:redshift://{_TAIL}")
    s3 = first_match(text, rf"(?i)s3[an]?://{_TAIL}")
    adls = first_match(text, rf"(?i)abfss?://{_TAIL}")
    gcs = first_match(text, rf"(?i)gs://{_TAIL}")
    return {
        "s3_bucket": first_match(s3, r"^(?i)s3[an]?://([^/]+)", 1),
        "adls_container": first_match(adls, r"^(?i)abfss?://([^@]+)@", 1),
        "gcs_bucket": first_match(gcs, r"^(?i)gs://([^/]+)", 1),
        "jdbc_url": first_match(text, rf"(?i)jdbc:[a-z]+://{_TAIL}"),
        "redshift_host": first_match(redshift, r"(?i)jdbc:redshift://([^:/]+)", 1),
        "redshift_database": first_match(redshift, r"/([^?/]+)(?:\?.*)?$", 1),
        "brokers": first_match(text, r"""(?i)(?:bootstrap[._]servers|kafka_brokers|brokers)["']?\s*[=:]\s*["']?([^\s"']+)""", 1),
        "topics": find_all(text, r"""(?i)kafka[._-]topics?\s*[=:]\s*['"]?([^\s"',]+)""", 1),
        "api_urls": find_all(text, rf"""(?i)https?://[^\s"'>,]*api[^\s"'>,]*"""),
    }
