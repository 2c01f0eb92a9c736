"""Scoring papers as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paperweave.operators.learning import batch_predict
from paperweave.operators.linear import LinearModel, batch_predict_text


def score_stream(papers: DataFrame, title_model: PipelineModel, abstract_model: PipelineModel, key: str = "paper_id") -> DataFrame:
    """The batch scorer on a stream: it keeps no state, so it is the same plan."""
    return batch_predict(papers, title_model, abstract_model, key)


def write_scores(
    papers: DataFrame, title_model: LinearModel, abstract_model: LinearModel, path: str, checkpoint: str, key: str = "paper_id"
) -> StreamingQuery:
    """Score a stream against the models' tables, ``key, label`` of each batch in a folder of its own below ``path``.

    The terms of a batch meet the model in one join and one sum per paper, so nothing is kept between batches. A batch
    that is run again replaces its folder.
    """

    def score(batch: DataFrame, number: int) -> None:
        batch_predict_text(batch, title_model, abstract_model, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return papers.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
