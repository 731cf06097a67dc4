"""What the two classifiers share: the labelled sample and scoring beside all other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Characters of a text that are worked on at once.
PIECE = 1 << 20


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string")) % of


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, allowed, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y) of at most ``sample_rows`` labelled rows.

    Rows without id or label are left out; an id labelled twice takes the
    larger label; ``allowed`` (a condition on the column ``id``) names the
    rows whose labels may be learned from.  The sample has a fixed bound, so
    it is broadcast and the texts stay where they are.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(allowed)
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(rows), "id").select("id", "text", "y")


def with_scores(docs: DataFrame, text_col: str, score: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]], least: float, names: tuple[str, str]) -> DataFrame:
    """``docs`` with a score and a 0/1 prediction appended; every other column passes untouched, by position."""
    at = docs.columns.index(text_col)
    fields = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            for row, values in score(batch.column(at)):
                part = batch.slice(row, len(values))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64()), pa.array((values >= least).astype(np.int32), pa.int32())], [*part.schema.names, *names])

    return docs.mapInArrow(run, fields)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, cut at spaces only: a longer run without one stays whole."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE)
        if end < 0 and (end := text.find(" ", at + PIECE)) < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]
