"""Classifiers fitted on bounded samples of labelled documents, in one task on an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def fitted(
    docs: DataFrame, labels: DataFrame, label: str, fit: Callable, *, modulus: int, remainder: int, per_class: int, longest: int, key: str = "doc_id", text: str = "text"
) -> object:
    """``fit(texts, labels, share)`` over at most ``per_class`` labelled rows of each class that are not held out, texts up to
    ``longest`` bytes, the same rows in the same order on every run; ``share`` is that of label 1 among all labelled rows that are
    not held out. Of rows that repeat a key the smallest text counts; conflicting labels count as 1.

    The chosen keys are a table of at most ``2 * per_class`` rows, so the join with the documents broadcasts them. The texts meet
    in one task, never on the driver, which gets the model alone."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key), modulus, remainder)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else float(share)
    order = F.xxhash64(F.col(key), F.lit(11))
    picked = [known.where(F.col("y") == y).orderBy(order, key).limit(per_class) for y in (0, 1)]
    some = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= longest)
    rows = some.join(F.broadcast(picked[0].unionByName(picked[1])), key).groupBy(key).agg(F.min("t").alias("t"), F.max("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y: list[int] = []

        def texts() -> Iterator[str]:
            for b in batches:
                y.extend(b["y"].tolist())
                yield from b["t"]

        yield pd.DataFrame({"model": [pickle.dumps(fit(texts(), y, share))]})

    found = rows.repartition(1).sortWithinPartitions(key).select("t", "y").mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit(iter(()), [], share)


def scored(docs: DataFrame, names: dict[str, str], model: object, run: Callable[[object, list[str]], list], *, operator: str, forget: Callable[[object], None], text: str, rows: int) -> DataFrame:
    """All columns of ``docs``, but for those named like a new one, with the columns ``names`` (name to type) behind them.
    ``run(model, texts)`` gives them for a slice of at most ``rows`` texts. One pass, no shuffle."""
    source = shared.without(docs, list(names))
    if text not in source.columns:
        raise ValueError(f"the text column {text} has the name of a new column")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"`{n}` {k}" for n, k in names.items())])
    kinds = {"double": pa.float64(), "int": pa.int32(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        shared.claim(operator, lambda: forget(m))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                found = run(m, [t or "" for t in part.column(text).to_pylist()])
                new = [pa.array(c, kinds[k]) for c, k in zip(found, names.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return source.mapInArrow(score, schema)


def one_class(y: np.ndarray) -> bool:
    return len(np.unique(y)) < 2
