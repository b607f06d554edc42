"""Caller-supplied models over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, column: str, model: Callable[[list[str]], Sequence[tuple]], outputs: str, default: tuple) -> DataFrame:
    """df with the model's outputs (a schema string) for its text column; a text on which the model fails gets the default."""
    names = [x.split()[0] for x in outputs.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[column].tolist()
            try:
                found = list(model(texts))
            except Exception:  # a failing batch is tried text by text
                found = []
                for text in texts:
                    try:
                        found.append(model([text])[0])
                    except Exception:
                        found.append(default)
            yield frame.assign(**{n: [f[i] for f in found] for i, n in enumerate(names)})

    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType(df.schema.fields + _parse_datatype_string(outputs).fields)
    return df.mapInPandas(run, schema)


def score_distinct(df: DataFrame, column: str, model: Callable[[list[str]], Sequence[tuple]], outputs: str, default: tuple) -> DataFrame:
    """Each distinct text is scored once and joined back; null texts get null outputs."""
    scored = score_batches(df.select(column).where(df[column].isNotNull()).distinct(), column, model, outputs, default)
    return df.join(scored, column, "left")
