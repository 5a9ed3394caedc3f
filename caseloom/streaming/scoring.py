"""Score reports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from caseloom.plans.training import ReportModels
from caseloom.sources.requests import distinct_requests, with_request_defaults


def score_requests(models: ReportModels, requests: DataFrame) -> DataFrame:
    """Scored reports for a batch or a stream of requests."""
    return models.score(with_request_defaults(requests))


def start_scoring(models: ReportModels, requests: DataFrame, output: str, checkpoint: str,
                  available_now: bool = False, late: str | None = None) -> StreamingQuery:
    """Write scored reports as Parquet, each exactly once.

    Scoring keeps no state. With ``late``, timed requests that are sent again
    within that time are scored once (``distinct_requests``). ``available_now``
    stops after the requests that are there.
    """
    if late is not None:
        requests = distinct_requests(requests, late).drop("received")
    writer = (score_requests(models, requests).writeStream.format("parquet")
              .option("path", output).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
