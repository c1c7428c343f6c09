"""Batch generation hook.

The reference calls a model server on all prompts at once.  Here generation runs over
the examples in Arrow batches: the user supplies a factory, a Python worker calls it
once (:mod:`spanpref.operators.workers`) and keeps the generator for all its tasks, and
the generator maps a list of prompts to a list of texts (empty text when the model
returned nothing).  Rows leave a task in the order they came in, so a task that is run
again gives the same rows if the generator does.  Outputs join back to the gold answers
on ``ex_id`` (J1).  Tests use a deterministic stub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanpref.operators.workers import held, new_key

GeneratorFactory = Callable[[], Callable[[list[str]], list[str]]]


def generate_predictions(examples: DataFrame, factory: GeneratorFactory, model: str, batch_rows: int = 256) -> DataFrame:
    """``examples(ex_id, query)`` -> ``(model, ex_id, pred_text)``; the generator gets ``batch_rows`` prompts at a time.

    A generator must return one text (or None) per prompt.
    """
    key = new_key()
    kind = examples.schema["ex_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = held("generator", key, factory)(part.column(1).to_pylist())
                if len(texts) != part.num_rows:
                    raise ValueError(f"{part.num_rows} prompts gave {len(texts)} texts")
                columns = [pa.array([model] * part.num_rows), part.column(0), pa.array([t or "" for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["model", "ex_id", "pred_text"])

    return examples.select("ex_id", "query").mapInArrow(run, f"model string, ex_id {kind}, pred_text string")


def empty_answer_factory() -> GeneratorFactory:
    """Deterministic stub generator used by tests: an empty result list for every prompt."""

    def make():
        return lambda prompts: ['{"results":[]}' for _ in prompts]

    return make
