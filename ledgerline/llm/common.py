"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python stage turns into objects at once; long texts would otherwise pile up.
SLICE = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; a cluster without it uses the warehouse.
    """
    conf = spark.conf
    base = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            base = conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and any executor can read it.

    The folder goes with discard(), at the end of the scratch() around, or else of the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _OPEN:
        _OPEN[-1].frames.append(out)
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what cut() wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)


class scratch:
    """with scratch() as own: what cut() writes inside is deleted at the end, but for what own.keep() was given."""

    def __enter__(self) -> scratch:
        self.frames: list[DataFrame] = []
        _OPEN.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames = [f for f in self.frames if f is not df]
        outer = _OPEN[: _OPEN.index(self)]
        if outer:
            outer[-1].frames.append(df)
        return df

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)
        discard(*self.frames)


_OPEN: list[scratch] = []


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(docs: DataFrame, carry: Iterable[str] | None = None, **own: str) -> DataFrame:
    """`doc`, a struct of the columns `carry` of docs (all by default), beside copies of some columns under own names.

    So the columns that an operator makes can't clash with the caller's.
    """
    names = docs.columns if carry is None else list(carry)
    return docs.select(F.struct(*map(quoted, names)).alias("doc"), *(quoted(c).alias(n) for n, c in own.items()))


def unpack(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The caller's columns again."""
    return df.select(*(F.col("doc")[c].alias(c) for c in columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has (letter case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, *columns: int, step: int = SLICE) -> Iterator[list[list]]:
    """The columns' values as Python lists, `step` rows at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield [part.column(c).to_pylist() for c in columns]


def append_columns(
    df: DataFrame, value: Column, added: T.StructType, make: Callable[[Iterable], Iterator[list[tuple]]], gone: Iterable[str] = ()
) -> DataFrame:
    """df without the columns `gone`, with the columns `added`, made by Python from the one column `value`.

    make() gets an iterator of lists of values and yields one list of tuples for each.  Other columns pass
    through Arrow untouched, whatever their names.
    """
    (arg,) = fresh(df, "_arg")
    gone = set(gone)
    stay = [f for f in df.schema.fields if f.name not in gone]
    n, width = len(stay), len(added)
    schema = T.StructType([*stay, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(added)
        sizes: list[pa.RecordBatch] = []

        def feed():
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    sizes.append(batch.slice(at, SLICE))
                    yield sizes[-1].column(n).to_pylist()

        for rows in make(feed()):
            part = sizes.pop(0)
            extra = [pa.array([r[k] for r in rows], type=own.field(k).type) for k in range(width)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n], *extra], names=[*part.schema.names[:n], *(f.name for f in own)]
            )

    return df.select(*(quoted(f.name) for f in stay), value.alias(arg)).mapInArrow(run, schema)


def radix_threshold(df: DataFrame, key: str, k: int, bits: int = 16) -> int | None:
    """The k-th largest value of a non-null 64-bit column (None if there are fewer than k rows or k < 1).

    Exact selection by radix: each of 64/bits passes counts rows by the next digit below the prefix found so far,
    so the driver sees at most 2**bits counts, however many rows there are.
    """
    if k < 1:
        return None
    flipped = F.col(key).bitwiseXOR(F.lit(-(2**63)))  # orders signed values as unsigned digits
    prefix, left = 0, k
    for shift in range(64 - bits, -1, -bits):
        digit = F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(2**bits - 1))
        rows = df if shift == 64 - bits else df.where(F.shiftrightunsigned(flipped, shift + bits) == F.lit(prefix))
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if left <= n:
                prefix = prefix << bits | d
                break
            left -= n
        else:
            return None
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
