"""Label catalogs for texts of definitions and configurations.

Fixed values: label names and patterns, in the order in which they are tried.  Texts are lower-cased first.
"""

FRAMEWORKS = (
    ("AWS Glue", (r"\bglue\b", r"gluejob", r"glue_job", r"aws.*glue", r"glue.*crawler")),
    ("Amazon Redshift", (r"\bredshift\b", r"redshift_cluster", r"jdbc.*redshift")),
    ("Amazon EMR", (r"\bemr\b", r"elastic.?map.?reduce", r"emr_cluster")),
    ("Amazon Athena", (r"\bathena\b", r"aws.*athena")),
    ("Azure Data Factory", (r"\badf\b", r"azure.?data.?factory", r"datafactory", r"adf_pipeline")),
    ("Azure Synapse", (r"\bsynapse\b", r"synapse_analytics", r"azure.?synapse")),
    ("Azure ADLS", (r"\badls\b", r"data.?lake.?storage", r"abfss://", r"wasbs://")),
    ("Snowflake", (r"snowflake", r"snowflake_connector", r"snowflakecomputing")),
    ("Databricks", (r"\bdatabricks\b", r"dbfs://", r"databricks_cluster", r"dbx")),
    ("Apache Spark", (r"\bspark\b", r"pyspark", r"sparksession", r"spark_job")),
    ("Apache Kafka", (r"\bkafka\b", r"kafka_topic", r"confluent")),
    ("Apache Flink", (r"\bflink\b", r"flinkenvironment")),
    ("Apache Airflow", (r"\bairflow\b", r"dag\b", r"airflow_dag")),
    ("dbt", (r"\bdbt\b", r"dbt_project", r"dbt_model")),
    ("Apache Hive", (r"\bhive\b", r"hivecontext", r"hive_metastore")),
    ("BigQuery", (r"\bbigquery\b", r"bq_table", r"google.?bigquery")),
)

COMBINATIONS = (
    (("AWS Glue", "Amazon Redshift"), "Combo: Glue → Redshift"),
    (("Azure Data Factory", "Databricks"), "Combo: ADF → Databricks"),
    (("Azure Data Factory", "Azure Synapse"), "Combo: ADF → Synapse"),
    (("Apache Spark", "Snowflake"), "Combo: Spark → Snowflake"),
    (("AWS Glue", "Amazon Athena"), "Combo: Glue → Athena"),
)

SOURCES = (
    ("S3", (r"s3://", r"s3a://", r"s3n://", r"\baws.*s3\b", r"boto3.*s3")),
    ("ADLS Gen2", (r"abfss://", r"azure.*data.*lake", r"\badls\b")),
    ("WASB/Azure Blob", (r"wasbs://", r"wasb://", r"azure.*blob.*storage")),
    ("GCS", (r"gs://", r"google.*cloud.*storage", r"gcs_bucket")),
    ("JDBC/Redshift", (r"jdbc:redshift", r"redshift.*jdbc")),
    ("JDBC/PostgreSQL", (r"jdbc:postgresql", r"psycopg2", r"postgres.*conn")),
    ("JDBC/MySQL", (r"jdbc:mysql", r"pymysql", r"mysql.*connector")),
    ("JDBC/MSSQL", (r"jdbc:sqlserver", r"mssql", r"pyodbc.*sqlserver")),
    ("JDBC/Oracle", (r"jdbc:oracle", r"cx_oracle", r"oracle.*conn")),
    ("JDBC/Generic", (r"\bjdbc:", r"java\.sql\.DriverManager")),
    ("DynamoDB", (r"\bdynamodb\b", r"aws.*dynamo")),
    ("Cosmos DB", (r"cosmosdb", r"azure.*cosmos")),
    ("MongoDB", (r"\bmongodb\b", r"pymongo", r"mongo://", r"mongodb\+srv")),
    ("Kafka Topic", (r"kafka.*topic", r"bootstrap.*servers", r"confluent.*topic")),
    ("Kinesis", (r"\bkinesis\b", r"aws.*kinesis")),
    ("Event Hubs", (r"event.?hubs?", r"azure.*eventhub")),
    ("REST API", (r"https?://.*api\.", r"rest.*api", r"requests\.get\(", r"httpx\.", r"openapi")),
    ("GraphQL", (r"\bgraphql\b", r"gql\(")),
    ("SOAP/WS", (r"wsdl://", r"\bsoap\b", r"zeep\.")),
    ("SFTP", (r"\bsftp\b", r"paramiko", r"sftp://")),
    ("FTP", (r"\bftp://", r"ftplib")),
    ("Local FS", (r"file://", r"/mnt/", r"open\(.*['\"]r['\"]")),
    ("Snowflake Stage", (r"@.*stage", r"snowflake.*stage", r"copy into")),
)

# Tried without regard to case.
INGESTION = (
    (
        "AWS Glue Jobs",
        (
            r"gluejob", r"glue_job", r"aws_glue", r"glue.*crawler", r"glue.*trigger", r"'platform':\s*'glue'",
            r'"platform":\s*"glue"', r"platform.*glue", r"type.*gluejob",
        ),
    ),
    ("AWS Step Functions", (r"step.?function", r"statemachine", r"aws.*sfn")),
    ("AWS Lambda ETL", (r"lambda.*handler", r"aws.*lambda.*etl")),
    ("ADF Pipelines", (r"adf_pipeline", r"azure.*data.*factory.*pipeline", r"pipeline.*activity")),
    ("Azure Functions ETL", (r"azure.*function.*etl", r"azurefunction")),
    ("Apache Airflow DAGs", (r"dag_id", r"\bdag\b", r"airflow", r"@dag\b", r"pythonoperator", r"bashoperator")),
    ("Apache Spark Jobs", (r"spark.*job", r"sparksession", r"pyspark.*main", r"spark-submit")),
    ("Databricks Jobs", (r"databricks.*job", r"dbutils\.", r"notebook.*run")),
    ("Kafka Connect", (r"kafka.connect", r"kafka.*connector", r"debezium")),
    ("Apache Flink Jobs", (r"flink.*job", r"StreamExecutionEnvironment")),
    ("AWS Kinesis Firehose", (r"firehose", r"kinesis.*delivery")),
    ("dbt Jobs", (r"dbt.?run", r"dbt.?test", r"dbt.*model", r"dbt_project\.yml")),
    ("Informatica", (r"\binformatica\b", r"infa_session")),
    ("Talend", (r"\btalend\b", r"talend_job")),
    ("Pentaho/Kettle", (r"pentaho", r"\bkettle\b", r"\.ktr\b")),
    ("Fivetran", (r"\bfivetran\b",)),
    ("Airbyte", (r"\bairbyte\b", r"airbyte_connection")),
    ("Stitch", (r"\bstitch\b.*etl", r"stitchdata")),
    ("Meltano", (r"\bmeltano\b",)),
)

# Tried without regard to case; the first suite pattern that hits decides the suite label.
SUITE_PATTERNS = (
    r"great.?expectations", r"ge_suite", r"suite_name.*?'([^']+)'", r'suite_name.*?"([^"]+)"',
    r"checkpoint_name.*?'([^']+)'", r'checkpoint_name.*?"([^"]+)"', r"datacontext\(\)", r"batchrequest\(",
    r"\.run_checkpoint\(", r"context\.get_expectation_suite\(",
)

EXPECTATIONS = {
    "expect_column_values_to_not_be_null": "GE: Not Null check",
    "expect_column_values_to_be_unique": "GE: Uniqueness check",
    "expect_column_values_to_be_between": "GE: Range check",
    "expect_column_values_to_match_regex": "GE: Regex pattern check",
    "expect_column_values_to_be_in_set": "GE: Value set check",
    "expect_table_row_count_to_be_between": "GE: Row count range",
    "expect_column_mean_to_be_between": "GE: Column mean check",
    "expect_column_stdev_to_be_between": "GE: Column stdev check",
    "expect_column_pair_values_to_be_equal": "GE: Column pair equality",
    "expect_multicolumn_sum_to_equal": "GE: Multicolumn sum check",
    "expect_column_values_to_be_of_type": "GE: Data type check",
    "expect_table_columns_to_match_ordered_list": "GE: Schema validation",
}

SQL_CHECKS = (
    ("SQL: Row count assertion", (r"count\s*\(\s*\*\s*\)\s*(>|<|=|!=|>=|<=)\s*\d+",)),
    ("SQL: Null check", (r"where\s+\w+\s+is\s+null",)),
    ("SQL: Sum assertion", (r"sum\s*\([^)]+\)\s*(>|<|=|!=|>=|<=)\s*\d+",)),
    ("SQL: Distinct count check", (r"distinct\s+count",)),
    ("SQL: Range/BETWEEN check", (r"between\s+\d+\s+and\s+\d+",)),
    ("SQL: NOT IN set check", (r"not\s+in\s*\(",)),
    ("SQL: Assert row count", (r"assert\b.*\bcount\b",)),
    ("SQL: Custom DQ check", (r"dq_check|data_quality_check|quality_assertion",)),
    ("SQL: Data freshness check", (r"freshness_check|freshness_sla",)),
    ("SQL: Duplicate check", (r"duplicate.*check|check.*duplicate",)),
    ("SQL: Referential integrity", (r"referential.*integrity|foreign.*key.*check",)),
    ("SQL: Schema validation", (r"schema.*validation|column.*exists",)),
)

CHECK_TOOLS = (
    ("Soda DQ", (r"\bsoda\b",)),
    ("Soda Cloud", (r"soda.?cloud|sodacl",)),
    ("dbt Tests", (r"dbt.*test",)),
    ("dbt Schema Tests", (r"\.test\(.*schema\)",)),
    ("Monte Carlo", (r"monte.?carlo",)),
    ("Acceldata", (r"acceldata",)),
    ("Datafold", (r"datafold",)),
    ("Bigeye", (r"bigeye",)),
    ("Anomalo", (r"anomalo",)),
    ("Lightup", (r"lightup",)),
    ("re_data", (r"re_data",)),
    ("Pandera (Python DQ)", (r"pandera\.",)),
    ("Pydantic validation", (r"pydantic.*validator",)),
    ("Cerberus (Python DQ)", (r"cerberus\.",)),
    ("Custom DQ Framework", (r"custom_dq|CustomDQCheck",)),
)

CONFIDENCE = {"frameworks": 0.95, "sources": 0.90, "ingestion": 0.95, "checks": 0.85}

# Platform part of a catalog name -> framework; fragment of a catalog name -> source, in the order tried.
PLATFORM_FRAMEWORKS = {
    "glue": "AWS Glue", "redshift": "Amazon Redshift", "emr": "Amazon EMR", "athena": "Amazon Athena",
    "adf": "Azure Data Factory", "synapse": "Azure Synapse", "snowflake": "Snowflake", "databricks": "Databricks",
    "spark": "Apache Spark", "kafka": "Apache Kafka", "flink": "Apache Flink", "airflow": "Apache Airflow",
    "dbt": "dbt", "hive": "Apache Hive", "bigquery": "BigQuery",
}
URN_SOURCES = (
    ("s3", "S3"), ("redshift", "JDBC/Redshift"), ("snowflake", "Snowflake Stage"), ("kafka", "Kafka Topic"),
    ("mysql", "JDBC/MySQL"), ("postgres", "JDBC/PostgreSQL"), ("adls", "ADLS Gen2"), ("bigquery", "BigQuery"),
)
JOB_TYPES = {
    "GlueJob": "AWS Glue Jobs", "AirflowTask": "Apache Airflow DAGs", "SparkJob": "Apache Spark Jobs",
    "DataBricksJob": "Databricks Jobs", "AzureDataFactory": "ADF Pipelines",
}

# Sources whose connection details can be read out of a text.
EXTRACTABLE_SOURCES = (
    "S3", "ADLS Gen2", "WASB/Azure Blob", "GCS", "JDBC/Redshift", "Snowflake Stage", "Kafka Topic", "BigQuery",
    "JDBC/PostgreSQL", "JDBC/MySQL", "JDBC/MSSQL", "JDBC/Oracle", "JDBC/Generic", "REST API", "Microsoft Fabric",
)

# Capabilities of a definition: tokens in the whole text that show them.
FILE_TOKENS = ("csv", "json", "adls", "s3", "blob", "parquet", "delimited")
DATABASE_TOKENS = ("warehouse", "lakehouse", "sql", "table", "database")
STREAM_TOKENS = ("event", "stream", "kafka", "eventhub")

NOTIFICATION_TYPES = ("office365email", "sendemail", "teamsactivity", "webhook", "webhookactivity", "message")
VALIDATION_TYPES = ("ifcondition", "assert", "validation", "fail", "until", "switch")
NOTEBOOK_TYPES = ("tridentnotebook", "databricksnotebook", "synapsenotebook", "notebook")
TRANSFORM_TYPES = NOTEBOOK_TYPES + ("script", "storedprocedure", "sqlserverstoredprocedure")
FILE_DATASET_TOKENS = ("delimitedtext", "json", "parquet", "blob", "s3", "adls", "lakehouse", "file", "onelake")
DATABASE_DATASET_TOKENS = ("sql", "jdbc", "datawarehouse", "table", "warehousetable")

# Phrase -> check label, in the order tried.
CHECK_PHRASES = (
    ("count(*)", "row_count_check"), ("rowcount", "row_count_check"), ("is null", "null_check"),
    ("duplicate", "uniqueness_check"), ("distinct", "uniqueness_check"), ("schema", "schema_check"),
    ("status", "status_check"), ("ifcondition", "conditional_quality_gate"), ("@equals", "conditional_quality_gate"),
    ("failed", "status_check"),
)
EXPECTATION_CHECKS = (
    ("expect_column_values_to_not_be_null", "null_check"),
    ("expect_column_values_to_be_unique", "uniqueness_check"),
    ("expect_column_values_to_be_between", "range_check"),
)
LAYER_TOKENS = ("raw", "bronze", "silver", "gold", "unified")
