"""Readers, inventories, payloads and landing checks on small files."""

import pytest
from pyspark.sql import functions as F

from siltworks.plans.queries import sources
from siltworks.plans.scratch import scratch_path
from siltworks.sources import checks, inventory, payloads, readers


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_null_tokens_and_inference(spark, tmp_path):
    p = write(tmp_path, "a.csv", "i,d,b,s\n1,1.5,true,x\nNA,2,False,nan\n,null,,N/A\n")
    df = readers.read_file(spark, p, infer=True)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "x"), (None, 2.0, False, None), (None, None, None, None)]


def test_quoted_fields(spark, tmp_path):
    p = write(tmp_path, "q.csv", 'a,b\n"x, y","say ""hi"""\n')
    assert tuple(readers.read_file(spark, p).first()) == ("x, y", 'say "hi"')


def test_malformed_lines(spark, tmp_path):
    p = write(tmp_path, "m.csv", "a,b\n1,2\n3,4,5\n6\n")
    good, bad = readers.quarantined(readers.read_delimited(spark, p, bad_lines="quarantine"))
    assert [tuple(r) for r in good.collect()] == [("1", "2")]
    assert sorted(r[0] for r in bad.collect()) == ["3,4,5", "6"]
    assert readers.read_delimited(spark, p, bad_lines="skip").count() == 1
    assert readers.read_delimited(spark, p).count() == 3


def test_json_modes(spark, tmp_path):
    doc = write(tmp_path, "d.json", '\n [{"a": 1}, {"a": 2}]')
    lines = write(tmp_path, "l.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert readers.read_file(spark, doc).count() == 2
    assert readers.read_file(spark, lines).count() == 3


def test_json_files_of_all_kinds_side_by_side(spark, tmp_path):
    (tmp_path / "j").mkdir()
    write(tmp_path, "j/doc.json", '[{"a": 1},\n {"a": 2}]')
    write(tmp_path, "j/pretty.json", '{\n  "a": 3,\n  "b": "x"\n}')
    write(tmp_path, "j/lines.json", '\n{"a": 4}\n{"a": 5}\nbroken\n')
    write(tmp_path, "j/short.json", '[{"a": 6}, {"a": 7}]')
    write(tmp_path, "j/rubbish.json", "{ never closed\n")
    good, bad = readers.quarantined(readers.read_json(spark, f"{tmp_path}/j").cache())
    assert sorted(r["a"] for r in good.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r[0].split()[0] for r in bad.collect()) == ["broken", "{"]
    assert readers.read_json(spark, f"{tmp_path}/j/pretty.json").collect() == [(3, "x")]


def test_long_integers_keep_their_digits(spark, tmp_path):
    path = write(tmp_path, "ids.csv", "a,b,c,d\n1234567890123456781,99999999999999999999,1.5,1234567890123456789\n1234567890123456782,1,,0.5\n")
    df = readers.read_delimited(spark, path, infer=True)
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "double", "string"]
    assert [r["a"] for r in df.orderBy("a").collect()] == [1234567890123456781, 1234567890123456782]


def test_unknown_formats(spark, tmp_path):
    assert readers.read_unknown(spark, write(tmp_path, "x", '[{"a": 1},\n {"a": 2}]')).columns == ["a"]
    assert readers.read_unknown(spark, write(tmp_path, "y", "a;b,c\n1,2\n")).columns == ["a;b", "c"]
    assert readers.read_unknown(spark, write(tmp_path, "z", '{"a": 1,\n "b": 2}')).columns == ["a", "b"]
    with pytest.raises(readers.UnsupportedFormat):
        readers.read_file(spark, "x.exe")


def test_raw_source_prefers_the_explicit_path(spark, tmp_path):
    p = write(tmp_path, "a.csv", "a\n1\n")
    files = inventory.describe(inventory.list_files(spark, str(tmp_path)), F.lit("c"), F.lit("LOCAL"))
    assert readers.read_raw(spark, p)[0].count() == 1
    assert len(readers.read_raw(spark, None, files)) == 1
    assert len(readers.read_raw(spark, f"{tmp_path}/gone.csv", files)) == 1
    with pytest.raises(FileNotFoundError):
        readers.read_raw(spark, None, files.where("false"))


def test_raw_files_with_the_same_header_are_one_table(spark, tmp_path):
    for i in range(4):
        write(tmp_path, f"a{i}.csv", f"x,y\n{i},1\n")
    write(tmp_path, "b.csv", "y,z\n5,6\n")
    write(tmp_path, "c.json", '{"x": 7}\n')
    write(tmp_path, "d.json", '[{"x": 8},\n{"x": 9}]')
    files = inventory.describe(inventory.list_files(spark, str(tmp_path)), F.lit("c"), F.lit("LOCAL"))
    frames = readers.read_raw(spark, None, files)
    assert sorted((f.columns, f.count()) for f in frames) == [(["x"], 3), (["x", "y"], 4), (["y", "z"], 1)]


def test_strategies():
    s = readers.reader_strategy
    assert s({"preview_strategy": "Spark_ORC "}) == "spark_orc"
    assert s({"connector_type": "REST"}) == s({"connection_metadata": {"url": "u"}, "format": "csv"}) == "rest_api"
    assert s({"connection_metadata": {"table": "t"}}) == "spark_jdbc"
    assert [s({"format": f}) for f in ("tsv", "parquet", "")] == ["spark_delimited", "spark_parquet", "spark_file"]


def test_jdbc_options():
    meta = {"jdbc_url": "jdbc:x", "query": "select 1", "partition_column": "id", "lower_bound": 0, "upper_bound": 9}
    opts = readers.jdbc_options({"connection_metadata": meta})
    assert opts["dbtable"] == "(select 1) q" and opts["numPartitions"] == "64" and opts["partitionColumn"] == "id"
    assert readers.jdbc_options({"connection_metadata": {"jdbc_url": "u", "query": "q"}}) == {"url": "u", "query": "q"}


@pytest.mark.parametrize("payload, want", [
    ('{"items":[{"x":1},2]}', ['{"x":1}', '{"value":2}']),
    ('[{"p":1},[{"x":1}]]', ['{"x":1}']),
    ('{"q":1}', ['{"q":1}']),
    ('{"z": "[no", "data": "[no", "rows": [1]}', ['{"value":1}']),
    ("[]", []),
    ('[[1], [2]]', ['{"value":[1]}', '{"value":[2]}']),
    ("7", ['{"value":7}']),
    ("{broken", None),
])
def test_payload_records(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(payloads.records(F.col("p"))).first()[0] == want


def test_records_table_keeps_the_first_records_keys(spark):
    rows = spark.createDataFrame([(0, '{"a":1,"b":[1]}'), (1, '{"a":"x","c":2}')], "o int, record string")
    assert [tuple(r) for r in payloads.records_table(rows, order=["o"]).orderBy("o").collect()] == [(0, "1", "[1]"), (1, "x", None)]
    assert payloads.records_table(rows, union_keys=True).columns == ["o", "a", "b", "c"]


def test_header_problems(spark):
    def of(line, sep=","):
        return spark.range(1).select(checks.header_problems(F.lit(line), sep)).first()[0]

    assert of("a,a,,b") == ["Duplicate column names found", "Invalid column name found"]
    assert of("a|b", "|") == [] and of("") == ["Dataset has no columns"]


def test_table_problems(spark):
    assert checks.table_problems(spark.range(1).toDF("a")) == []
    assert checks.table_problems(spark.range(0).selectExpr("id as a", "id as ` a`")) == ["Duplicate column names found", "Dataset is empty"]


def test_listing_reads_no_content(spark, tmp_path):
    write(tmp_path, "a.csv", "a\n")
    files = inventory.list_files(spark, str(tmp_path))
    assert "content:binary" not in files._jdf.queryExecution().executedPlan().toString()


def test_parse_errors_per_file(spark, tmp_path):
    write(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n")
    row = checks.parse_errors(spark, str(tmp_path), ["a", "b"]).first()
    assert (row["rows"], row["bad_rows"]) == (2, 1)


def test_catalog_csv_round_trip(spark):
    from siltworks.operators import catalog as cat
    from siltworks.operators.literals import literal_table
    from siltworks.plans.schemas import CATALOG, CATALOG_COLUMNS

    row = ("d1", "p", "c", "S3", "f", 'o,"x".csv', "CSV", None, "b", "s", True, None, "", None, None, "B", None, None)
    path = scratch_path(spark, "catalog-csv")
    cat.export_csv(literal_table(spark, [row], CATALOG), path)
    back = cat.import_csv(spark, path)
    assert back.columns == list(CATALOG_COLUMNS)
    got = back.first()
    assert got["source_object"] == 'o,"x".csv' and got["is_active"] == "true" and got["load_type"] is None
    assert cat.missing_columns(back.drop("client_name")) == ["client_name"]


def test_long_integers_of_keys_past_five_digits(spark, tmp_path):
    keys = [7, 99_999, 100_000, 1_234_567, 123_456_789]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in sources.read_csv_long_integers_all(spark, str(tmp_path)).collect())
    assert got == [(k, int(f"12345678901234{k % 10**5:05}"), f"99999999999999{k % 10**8:08}") for k in keys]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a;b\n1;\"x;y\"\n2;z\n3;w, v\n", (";", '"', True)),
        ("1|'p|q'|2.5\n2|'it''s'|3\n3|r|4\n", ("|", "'", False)),
        ("name,city\nann,bonn\nbob,rome\n", (",", '"', True)),
        ("ann,bonn\nbob,rome\nann,oslo\n", (",", '"', False)),
        ("id\tday\n1\t2024-01-01\n2\t2024-02-01\n3\n4\tNA\tmore\n5\tNA\n", ("\t", '"', True)),
        ("x,y,\n1,2,3\n", (",", '"', False)),
        ("id,id\n1,2\n", (",", '"', False)),
        ("one column\nof text\n", (",", '"', False)),
        ("", (",", '"', False)),
    ],
)
def test_dialects_are_inferred(spark, tmp_path, text, want):
    assert tuple(readers.infer_dialect(spark, write(tmp_path, "d.txt", text))) == want


def test_inferred_files_are_read(spark, tmp_path):
    p = write(tmp_path, "d.txt", "k;v\n1;'a;b'\n2;'it''s'\n")
    assert [tuple(r) for r in readers.read_inferred(spark, p).select("k", "v").collect()] == [(1, "a;b"), (2, "it's")]
    for i, head in enumerate(("k,v", "k,w")):
        write(tmp_path, f"part-{i}.csv", f"{head}\n1,a\n")
    parts = [str(tmp_path / f"part-{i}.csv") for i in range(2)]
    assert not readers.infer_dialect(spark, parts).header  # files with headers of their own share none
