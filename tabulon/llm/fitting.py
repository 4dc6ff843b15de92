"""Fitting a linear model on a bounded sample of labelled rows in one task, and sending its weights out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, most_rows: int) -> DataFrame:
    """text and y of the labelled rows where `train` (a condition on doc_id) holds, about `most_rows` at most.

    Which rows is a matter of a hash of the id alone, so it is the same in every run. Null ids and null labels don't count;
    of texts under one id the first in order is learned from, so repeated ids don't make the sample larger.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).filter(train).distinct()
    n = known.count()
    if n > most_rows:  # twice as many or more in the sample is beyond any chance
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most_rows / n * (1 << 30)))
    # a few thousand ids, as counted, go to the documents; the documents stay where they are
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fitted(sample: DataFrame, features, fit):
    """fit(list of (index array, value array), y array) -> {name: array}, run in one task over the sample's features.

    Features are made where the texts are; only they are moved. Rows are taken in order of a hash of the id.
    """
    import io

    import numpy as np

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            at = pa.array([x[0].astype("<u4").tobytes() for x in made], pa.binary())
            values = pa.array([x[1].astype("<f4").tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, values], ["doc_id", "y", "at", "v"])

    def train(batches):
        import pyarrow as pa

        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        rows.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, r[1], r[2]))
        data = [(np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<f4")) for r in rows]
        out = io.BytesIO()
        np.savez_compressed(out, **fit(data, np.array([r[1] for r in rows], dtype=np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    made = sample.mapInArrow(extract, "doc_id long, y double, at binary, v binary")
    model = made.repartition(1).mapInArrow(train, "model binary").first()
    with np.load(io.BytesIO(model[0])) as arrays:
        return {k: arrays[k] for k in arrays.files}
