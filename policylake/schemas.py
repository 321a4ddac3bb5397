"""Schemas of the persistent tables and the records in flight. Every column may be null: null means unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = "struct<page_number:int,source_text:string,section:string,table_index:int,row_index:int,column_index:int,cell_text:string,ocr_confidence:double,original_text:string,english_interpretation:string,consistency:string,validation_reason:string,validation_confidence:double,source_url:string>"
TABLES = {
    "source_registry": "id long, department string, source_name string, official_url string, source_type string, active boolean, last_checked timestamp, last_successful_check timestamp, created_at timestamp",
    "schemes": "id long, slug string, name string, department string, state string, created_at timestamp, updated_at timestamp",
    "documents": "id long, source_url string, source_page_url string, file_hash string, file_path string, title string, document_type string, downloaded_at timestamp",
    "scheme_versions": "id long, scheme_id long, version_label string, document_id long, document_hash string, document_date date, source_url string, published_date date, effective_from date, effective_until date, status string, extracted_text string, created_at timestamp",
    "eligibility_rules": "id long, scheme_version_id long, rule string, type string, category string, value string, semantic_confidence double, rule_scope string, consistency string, review_required boolean, review_reasons array<string>, rule_data string",
    "rule_evidence": "id long, rule_id long, page_number int, section string, evidence_text string, source_url string, ocr_confidence double",
    "update_logs": "id long, scheme_id long, old_version_id long, new_version_id long, change_type string, summary string, eligibility_relevance string, changes string, detected_at timestamp, created_at timestamp, status string",
    "trace": "run string, step_number int, tool_name string, arguments map<string,string>, success boolean, execution_time_ms double, error string",
}
STRUCTURED_PAGE = "struct<page_number:int,page_type:string,tags:array<string>,extraction_method:string,full_text:string,avg_confidence:double,low_conf_percentage:double,blocks:array<struct<text:string,confidence:double>>,tables:array<struct<rows:array<struct<row_index:int,cells:array<struct<row:int,column:int,bbox:array<double>,text:string,confidence:double>>>>>>>"
RULE = "struct<rule:string,type:string,value:string,category:string,semantic_confidence:double,review_required:boolean,evidence:struct<page_number:int,source_text:string,ocr_confidence:double>>"
#: Values that a column may have.
ALLOWED = {("scheme_versions", "status"): ["ACTIVE", "ARCHIVED", "REVIEW"], ("eligibility_rules", "type"): ["eligibility", "exclusion"]}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def create_tables(spark: SparkSession, database: str = "policylake") -> list[str]:
    """Create what is missing; what is there stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
    return [f"{database}.{name}" for name in TABLES]


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the table's columns; a value that a column may not have is an error when the row is read."""
    for (name, column), values in ALLOWED.items():
        if name == table and column in df.columns:
            value = F.upper(F.trim(column)) if column == "status" else F.col(column)
            df = df.withColumn(column, F.when(value.isNull() | value.isin(values), value).otherwise(F.raise_error(F.concat(F.lit(f"{table}.{column} can't be "), F.col(column))).cast("string")))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])
