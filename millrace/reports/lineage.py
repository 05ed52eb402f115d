"""Where each pipeline's data comes from, what is done to it and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.labels import arrow_label, bracket_label


STAGES = ("ingestion", "transformation", "delivery")


def describe_stages(configs: DataFrame) -> DataFrame:
    """Lineage rows from pipeline configurations, one per row of ``configs``.

    ``configs`` has the structs ``ingestion``, ``transformation`` and ``delivery``, each with ``type``
    and whatever fields its types use; a missing stage is NULL. Other columns stay.
    """
    fields = {f.name: f.dataType.names for f in configs.schema.fields if f.name in STAGES}

    def of(stage: str, name: str) -> Column:
        if name not in fields.get(stage, ()):
            return F.lit(None).cast("string")
        return F.col(f"{stage}.{name}")

    def s3(stage: str, bucket: str, key: str) -> Column:
        return F.concat(F.lit("s3://"), of(stage, bucket), F.lit("/"), F.coalesce(of(stage, key), F.lit("")))

    source, transform, delivery = of("ingestion", "type"), of("transformation", "type"), of("delivery", "type")
    return configs.select(
        *[c for c in configs.columns if c not in STAGES],
        source.alias("source_type"),
        F.when(source == "s3_csv", s3("ingestion", "source_bucket", "source_key"))
        .when(source.isin("minio_csv", "wizard_csv"), s3("ingestion", "bucket", "key"))
        .when(source == "http_api", of("ingestion", "url"))
        .when(source == "jdbc", of("ingestion", "table")).alias("source_location"),
        transform.alias("transform_type"),
        F.when(transform == "sql", of("transformation", "sql_file")).alias("transform_target"),
        delivery.alias("delivery_type"),
        F.when(delivery == "s3_publish", s3("delivery", "dest_bucket", "dest_prefix"))
        .when(delivery == "slack_notify", of("delivery", "channel"))
        .when(delivery == "webhook", of("delivery", "url")).alias("delivery_location"),
    )


def lineage_report(lineage: DataFrame) -> DataFrame:
    """One readable line per pipeline, by id."""
    return lineage.select(
        "pipeline_id",
        arrow_label(F.col("source_type"), F.col("source_location")).alias("source"),
        bracket_label(F.col("transform_type"), F.col("transform_target")).alias("transform"),
        arrow_label(F.col("delivery_type"), F.col("delivery_location")).alias("delivery"),
    ).orderBy("pipeline_id")
