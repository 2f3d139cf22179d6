"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.session import checkpoint_dir, prepare

#: The white space that separates words in every word rule of this package.
ASCII_SPACE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and the whole text (null: empty), so no other column can clash."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` as a parquet table in the shared checkpoint folder."""
    folder = f"{checkpoint_dir(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def per_document(docs: DataFrame, row: Callable[[str], tuple], names: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """One output row for each input row: doc_id and what ``row(text)`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(n for n, _ in names)])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, {ddl}")


def filter_rows(docs: DataFrame, keep: Callable[[str], bool], text_column: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts, with all columns as they were."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keep(text or "") for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
