"""What every training-data query needs of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leafmill.session import ship

#: Rows in one Arrow batch: documents and pages are some kilobytes each.
BATCH_ROWS = "1000"


def prepared(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
