"""File sources and sinks.

CSV files are bound by header name with an explicit schema (the reference's
positional ``.import`` cannot load its own files correctly), extra columns are
ignored and missing ones raise before any job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlift.functions.guards import require_columns
from adlift.session import scratch_path
from adlift.sources.mapped import CampaignTables
from adlift.sources.schema import schema_for

TABLES = ("customers", "campaigns", "exposures", "outcomes")


#: Keys of the two fact tables.
FACT_KEYS = ("customer_id", "campaign_id")


def read_csv_table(spark: SparkSession, path: str, table: str,
                   id_type: T.DataType = T.StringType()) -> DataFrame:
    """A1: read one header CSV and bind its columns by name to the typed schema.

    A missing required column raises; a missing nullable one is filled with typed nulls."""
    schema = schema_for(table, id_type)
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    require_columns(raw, [f.name for f in schema.fields if f.nullable is False], what=f"{table} file")
    return raw.select([(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def read_campaign_csvs(spark: SparkSession, directory: str,
                       id_type: T.DataType = T.StringType()) -> CampaignTables:
    """A1: ``customers.csv campaigns.csv exposures.csv outcomes.csv`` from one folder."""
    d = directory.rstrip("/")
    return CampaignTables(**{t: read_csv_table(spark, f"{d}/{t}.csv", t, id_type) for t in TABLES})


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write a fact frame as a catalog table in ``buckets`` files by (customer_id, campaign_id), and read it: joins and
    aggregates on both keys then need no shuffle."""
    (df.repartition(buckets, *FACT_KEYS).write.mode("overwrite").format("parquet").bucketBy(buckets, *FACT_KEYS)
     .sortBy(*FACT_KEYS).option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def load_tables(tables: CampaignTables, base: str, buckets: int | None = None, prefix: str = "campaign") -> CampaignTables:
    """A2: write the typed tables under ``base`` and read them back. With ``buckets``, exposures and outcomes become
    catalog tables <prefix>_exposures and <prefix>_outcomes, co-partitioned by (customer_id, campaign_id)."""
    out = {}
    for t in TABLES:
        df, path = getattr(tables, t), f"{base.rstrip('/')}/{t}"
        if buckets and t in ("exposures", "outcomes"):
            out[t] = save_bucketed(df, f"{prefix}_{t}", path, buckets)
        else:
            df.write.mode("overwrite").parquet(path)
            out[t] = df.sparkSession.read.parquet(path)
    return CampaignTables(**out)


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """A4: CTAS. Write to the shared checkpoint folder and read back, which cuts
    lineage and survives executor loss (unlike an in-memory cache)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}")
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A5: a named view over a (lazy) result."""
    df.createOrReplaceTempView(name)
    return df


def export_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                   single_file: tuple[str, ...] = ()) -> dict[str, str]:
    """Write every result under ``out_dir/<name>``; the folder is created.

    Results named in ``single_file`` (reports with a row bound) are written as
    one file for dashboard tools; all others keep their partitioning.
    """
    paths = {}
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = (df.coalesce(1) if name in single_file else df).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.format(fmt).save(path)
        paths[name] = path
    return paths


def write_report_text(report: DataFrame, path: str) -> None:
    """Write the ordered report lines (E26) as a text file."""
    (report.orderBy("section_order", "line_order").select("text")
     .coalesce(1).write.mode("overwrite").text(path))
