"""Scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_POSTING = (
    "source string, source_id string, source_job_id string, source_url string, title_raw string, company_name_raw string, description_raw string, "
    "description_role_specific string, industry_raw string, location_raw string, work_mode_raw string, salary_raw string, experience_raw string, "
    "education_raw string, posted_at_raw string, source_updated_at string, collected_at timestamp, content_hash_sha256 string, raw_payload map<string,string>"
)
REFERENCE = {
    "occupation": "onetsoc_code string, title string, description string",
    "task": "onetsoc_code string, task_id string, task string, task_type string",
    "interest": "onetsoc_code string, element_name string, scale_id string, data_value double",
    "rated_skill": "onetsoc_code string, element_id string, element_name string, scale_id string, data_value double, recommend_suppress string, not_relevant string",
    "software": "onetsoc_code string, workplace_example string, element_name string, hot_technology string, in_demand string",
}
WAREHOUSE = ["jobs_clean", "job_skills", "job_lifecycle", "career_demand_summary", "career_skill_matrix", "career_evidence", "career_evidence_facts", "career_profiles"]


def need_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_snapshot(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """S1. A Parquet snapshot; missing columns raise before any job."""
    reader = spark.read.schema(schema) if schema else spark.read
    return need_columns(reader.parquet(path), required)


def landing(spark: SparkSession, path: str, schema: str, required: list[str], multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON files under a fixed schema: the good rows, and the bad ones as ``file, reason, record``.

    A row is bad if its line (with ``multi_line`` its whole file) is no JSON of the schema, or if a required column is null or
    blank. A file may hold objects or arrays of them. Columns that the schema does not name are left out.
    """
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("multiLine", multi_line)
    rows = reader.json(path)
    names = [c for c in rows.columns if c != "_corrupt"]
    lacking = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required)))
    told = rows.select(*names, "_corrupt", lacking.alias("_lacking"), F.col("_metadata.file_name").alias("_file"))
    broken, short = F.col("_corrupt").isNotNull(), F.size("_lacking") > 0
    reason = F.when(broken, "not JSON of this schema").otherwise(F.concat(F.lit("missing: "), F.array_join("_lacking", ", ")))
    record = F.coalesce("_corrupt", F.to_json(F.struct(*names)))
    return told.filter(~broken & ~short).select(*names), told.filter(broken | short).select(F.col("_file").alias("file"), reason.alias("reason"), record.alias("record"))


def read_raw_postings(spark: SparkSession, path: str) -> DataFrame:
    """S2. JSON arrays of raw postings."""
    return spark.read.schema(RAW_POSTING).option("multiLine", True).json(path)


def land_raw_postings(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """S2. Raw postings, and the rows that are none: broken ones, and those without source, id or title."""
    return landing(spark, path, RAW_POSTING, ["source", "source_job_id", "title_raw"], multi_line)


def flatten_board_payload(df: DataFrame, payload: str, source: str = "board_api") -> DataFrame:
    """S3. One row for each job of a board's payload, the first of equal ids.

    ``df`` has ``source_id``, ``fetched_at`` and the payload as JSON text. A location is an object with a name, or a
    text; the names of departments (objects or texts) are joined; the job's JSON, its fields in order, is hashed. Broken
    payloads, and those without a list of jobs, give no rows.
    """
    raw = df.select("source_id", "fetched_at", F.posexplode(F.try_variant_get(F.try_parse_json(F.col(payload)), "$.jobs", "array<variant>")).alias("pos", "job"))
    got = lambda path, kind="string", of="job": F.try_variant_get(F.col(of) if isinstance(of, str) else of, path, kind)
    text = lambda path, of="job": F.when(~F.schema_of_variant(got(path, "variant", of)).rlike("^(OBJECT|ARRAY)"), got(path, "string", of))
    place = F.coalesce(text("$.location.name"), text("$.location"))
    names = F.transform(got("$.departments", "array<variant>"), lambda d: F.trim(F.coalesce(text("$.name", d), text("$", d))))
    rows = raw.select(
        F.lit(source).alias("source"), "source_id", text("$.id").alias("source_job_id"), text("$.absolute_url").alias("source_url"), text("$.title").alias("title_raw"), text("$.content").alias("description_raw"),
        place.alias("location_raw"), F.coalesce(F.array_join(F.filter(names, lambda x: x != ""), " | "), F.lit("")).alias("industry_raw"), text("$.updated_at").alias("source_updated_at"), "fetched_at",
        F.sha2(F.to_json("job").cast("binary"), 256).alias("content_hash_sha256"), "pos",
    )
    rank = F.row_number().over(W.partitionBy("source", "source_id", "source_job_id").orderBy("fetched_at", "pos"))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r", "pos")


def read_reference_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S4. Rows of a reference file ``{"row": [...]}``."""
    return spark.read.schema(f"row array<struct<{REFERENCE[kind].replace(' string', ': string').replace(' double', ': double')}>>").option("multiLine", True).json(path).select(F.inline("row"))


def land_reference_rows(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """S4. Rows of reference files ``{"row": [...]}``; files that are none, and rows without a code."""
    row = f"row array<struct<{REFERENCE[kind].replace(' string', ': string').replace(' double', ': double')}>>"
    whole, bad = landing(spark, path, row, ["row"], multi_line=True)
    rows = whole.select(F.inline("row"))
    lacking = F.trim(F.coalesce("onetsoc_code", F.lit(""))) == ""
    short = rows.filter(lacking).select(F.lit(None).cast("string").alias("file"), F.lit("missing: onetsoc_code").alias("reason"), F.to_json(F.struct("*")).alias("record"))
    return rows.filter(~lacking), bad.unionByName(short)


def read_taxonomy(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S5. ``id, name, aliases, entity_ord, taxonomy_version`` of the taxonomy's skills, careers or locations."""
    id_, name = {"skills": ("skill_id", "canonical_name"), "careers": ("career_id", "canonical_name"), "locations": ("province", "province")}[kind]
    fields = f"{id_}: string, aliases: array<string>" + (f", {name}: string" if name != id_ else "")
    whole = spark.read.schema(f"taxonomy_version string, {kind} array<struct<{fields}>>").option("multiLine", True).json(path)
    return whole.select("taxonomy_version", F.posexplode(kind).alias("entity_ord", "e")).select(F.col(f"e.{id_}").alias("id"), F.col(f"e.{name}").alias("name"), F.col("e.aliases").alias("aliases"), "entity_ord", "taxonomy_version")


def career_code_map(mapping: DataFrame) -> DataFrame:
    """S6. ``career_id, onetsoc_code`` from a table of ``career_id`` and an array of codes."""
    return mapping.select("career_id", F.explode("codes").alias("onetsoc_code")).distinct()


PARENT_KEYS = ["job_id", "dedup_group_id", "career_id", "career_name", "province", "work_mode", "posted_at"]


def split_jobs_skills(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S7. Postings without their skills, and one row for each skill with the posting's keys."""
    keys = [k for k in PARENT_KEYS if k in df.columns]
    return df.drop("skills"), df.select(*keys, F.inline("skills"))


def write_report(df: DataFrame, path: str, fmt: str) -> None:
    """S8. A report as JSON or CSV."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        jsonify_complex(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version_col: str = "snapshot_version") -> str:
    """S9. All tables as one version below ``root``; the manifest, written last, makes the version visible."""
    version = uuid.uuid4().hex
    manifest = None
    for name, df in tables.items():
        path = f"{root}/data/{version}/{name}"
        df.write.parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
        versions = F.array_sort(F.collect_set(version_col)) if version_col in df.columns else F.array().cast("array<string>")
        row = written.agg(F.count("*").alias("row_count"), versions.alias("snapshot_versions"))
        row = row.select(F.lit(name).alias("dataset"), "row_count", "snapshot_versions", F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """S11. A warehouse table of the version published last; unknown names raise."""
    if name not in WAREHOUSE:
        raise ValueError(f"unknown table: {name}")
    last = spark.read.parquet(f"{root}/manifest").filter(F.col("dataset") == name).orderBy(F.desc("published_at")).select("version").first()
    if last is None:
        raise ValueError(f"not published: {name}")
    return spark.read.parquet(f"{root}/data/{last['version']}/{name}")


def jsonify_complex(df: DataFrame) -> DataFrame:
    """S10. Structs, arrays and maps as JSON text, for flat sinks."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(F.col(c)) for c in nested}) if nested else df


def overwrite_if_nonempty(df: DataFrame, path: str) -> bool:
    """S12. Replace a snapshot, but never by an empty one.

    The new snapshot is written beside the old one, which is moved away only then: a failed write leaves it as it was,
    and ``df`` may read from it.
    """
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = {p: hadoop.Path(p) for p in (fresh, old, path)}
    fs = place[path].getFileSystem(spark._jsc.hadoopConfiguration())
    if spark.read.schema(df.schema).parquet(fresh).isEmpty():
        fs.delete(place[fresh], True)
        return False
    if fs.exists(place[path]):
        fs.rename(place[path], place[old])
    fs.rename(place[fresh], place[path])
    fs.delete(place[old], True)
    return True


def market_snapshot(spark: SparkSession, path: str, required: list[str], fallback: DataFrame) -> DataFrame:
    """S13. The published market table, or a fixed fallback if it is missing or lacks columns; ``data_mode`` says which."""
    from pyspark.errors import AnalysisException

    try:
        found = need_columns(spark.read.parquet(path), required)
    except (AnalysisException, ValueError):
        return fallback.withColumn("data_mode", F.lit("fallback"))
    return found.withColumn("data_mode", F.lit("observed"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, content`` for document extraction."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def jdbc_publish(tables: dict[str, DataFrame], url: str, properties: dict[str, str]) -> None:
    """S9. The same tables to a database; nested columns as JSON text."""
    for name, df in tables.items():
        jsonify_complex(df).write.jdbc(url, name, mode="overwrite", properties=properties)


