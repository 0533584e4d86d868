"""What the operators and their queries share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.bytesops import release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that nothing is learned from; a null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lets Spark hand at most ``size`` of texts to a Python worker at once (unless the session says otherwise), which
    bounds a worker's memory whatever the length of the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB", "-1b", "-1"):
        spark.conf.set(key, size)


def fresh_name(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


SLOTS = 1 << 20


def in_slots(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, how: str = "left_semi") -> DataFrame:
    """Rows whose key shares a hash slot with a wanted one (or, with ``left_anti``, the others), before a join on the key.

    At most ``SLOTS`` slots are broadcast, however many keys are wanted.  The test only saves work: rows that share a
    slot by chance stay.
    """
    slot = fresh_name(rows.columns, "_slot")
    slots = wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(SLOTS)).alias(slot)).distinct()
    return rows.join(F.broadcast(slots), F.pmod(F.xxhash64(key), F.lit(SLOTS)) == slots[slot], how)


def append_column(docs: DataFrame, text_col: str, kind: str, compute: Callable[[pa.Array], pa.Array]) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one more, made batch by batch from the texts; also its name, which no column has."""
    name = fresh_name(docs.columns, "_new")
    at = docs.columns.index(text_col)

    def extend(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, compute(batch.column(at))], names=[*batch.schema.names, name])
        release()

    from pyspark.sql import types as T

    return docs.mapInArrow(extend, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])), name
