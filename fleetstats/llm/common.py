"""Helpers shared by the text operators: bounded slices of Arrow batches, shared folders."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetstats.session import ensure_checkpoint_dir, scratch_dir

#: Bytes of text turned into Python objects at once. Spark already bounds an Arrow batch
#: by bytes; words of a batch need several times its size, so operators go slice by slice.
SLICE_BYTES = 2_000_000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text (null: empty); extra columns never reach a worker."""
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of (id, text) batches, in slices of about ``limit`` bytes of text.

    A text is never cut: a longer one makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                part = batch.slice(start, i - start)
                yield part.column(0).to_pylist(), part.column(1).to_pylist()
                start, held = i, 0
            held += int(n) + 1
        part = batch.slice(start)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with so many underscores that no column of ``docs`` has it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_texts(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text (null: empty) ``keep`` accepts, filtered where they lie.

    ``keep`` takes a slice of texts. All columns of any type pass through unchanged.
    """
    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(last)],
                                               names=["id", "text"])
            mask = [ok for _, part in text_slices([texts]) for ok in keep(part)]
            yield batch.select(range(last)).filter(pa.array(mask, pa.bool_()))

    widened = docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused(docs, "_whole_text")))
    return in_tasks(widened, run, docs.schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return scratch_dir(spark, name)


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` (small enough for the driver) below the shared folder; its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark, 'files')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    for a in range(0, len(data), 1 << 22):
        out.write(bytearray(data[a:a + (1 << 22)]))
    out.close()
    return path.toString()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library wherever the session was started from.

    Its sources go to the cluster once for each session, as ``addPyFile`` does it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fleetstats_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(share_file(spark, f"fleetstats-{uuid.uuid4().hex[:12]}.zip", packed.getvalue()))
    sc._fleetstats_shipped = True


def in_tasks(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` by a function of this library."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there; its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
