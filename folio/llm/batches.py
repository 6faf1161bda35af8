"""Arrow batches of few rows: texts are long, and a batch is held by Spark and by Python, in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 250
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS rows. It stays so: plans run later."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
