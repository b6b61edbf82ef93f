"""Column lists and Spark schemas of the control tables."""

CATALOG = (
    "dataset_id string, pipeline_id string, client_name string, source_type string, source_folder string, "
    "source_object string, file_format string, raw_layer_path string, target_layer_bronze string, "
    "target_layer_silver string, is_active boolean, load_type string, upsert_key string, watermark_column string, "
    "partition_column string, last_seen_batch string, created_at timestamp, updated_at timestamp"
)
CATALOG_COLUMNS = tuple(part.split()[0] for part in CATALOG.split(", "))
CATALOG_SYSTEM = (
    "pipeline_id", "client_name", "source_type", "source_folder", "source_object", "file_format", "raw_layer_path",
    "target_layer_bronze", "target_layer_silver", "last_seen_batch",
)
CATALOG_HUMAN = ("load_type", "upsert_key", "watermark_column", "partition_column")
CATALOG_REQUIRED = (
    "dataset_id", "pipeline_id", "client_name", "source_type", "source_folder", "source_object", "file_format",
    "target_layer_bronze", "target_layer_silver",
)

DQ_RULES = (
    "id string, dataset_id string, column_name string, expected_data_type string, dq_rule string, rule_value string, "
    "severity string, is_active boolean, created_at timestamp, updated_at timestamp"
)

INGESTION_LOG = (
    "ingestion_id string, client_name string, source_path string, source_object string, batch_id string, "
    "validation_status string, failed_validation_rules array<string>, ingestion_ts string"
)

RUN_RESULT = (
    "dataset_id string, dataset_name string, status string, reason string, raw_rows bigint, bronze_rows bigint, "
    "silver_rows bigint, gold_rows bigint, gold_status string, dq_violations bigint, dq_warnings bigint, "
    "bronze_path string, silver_path string, gold_path string, rejected_path string"
)
RUN_HISTORY = f"run_id string, batch_id string, client_name string, started string, finished string, {RUN_RESULT}"

VERSIONS = "dataset_id string, version bigint, batch_id string, path string, schema_json string"
WATERMARKS = "dataset_id string, batch_id string, watermark string"
DQ_DETAILS = (
    "run_id string, dataset_id string, bucket string, rule_id int, column string, rule string, expected string, "
    "count bigint, samples array<string>"
)

REPORT_COLUMNS = (
    "status", "dataset", "dataset_id", "raw_rows", "bronze_rows", "silver_rows", "gold_rows", "gold_status",
    "bronze_path", "silver_paths", "gold_paths", "rejected_paths", "dq_violations", "dq_warnings", "reason",
)
