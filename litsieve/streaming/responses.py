"""Responses that arrive while a batch of requests is under way.

Files of responses are picked up as they come and go, partitioned by job, into the response table.  A reply to a
sample of a job that has one already, as after a repeated delivery or a restart, is told by the stream's state, which
is keyed by job, record and sample and forgets after ``WAIT``; the table itself is never read.  The sink writes
a batch once, however often it is tried.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from litsieve.operators.screening import RESPONSE

#: How long a second reply to a sample is told; later ones do not count either, see ``screening.answers``.
WAIT = "7 days"


def collect_responses(spark: SparkSession, arrivals: str, table: str, checkpoint: str, wait: str = WAIT):
    """Start the stream from JSON-lines files in ``arrivals`` to the Parquet table ``table``; it ends when
    all that is there has been read.  Lines without a job, a record or a sample are left out."""
    came = F.col("_metadata.file_modification_time").alias("came")
    said = spark.readStream.schema(RESPONSE).json(arrivals).select("*", came).where("job is not null and record_id is not null and sample_idx is not null")
    first = said.withWatermark("came", wait).dropDuplicatesWithinWatermark(["job", "record_id", "sample_idx"]).drop("came")
    sink = first.writeStream.format("parquet").option("path", table).partitionBy("job")
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
