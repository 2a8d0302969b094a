"""What the operators share: word and space classes, the scratch folder, tokenizer files."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from editpulse.session import configure, run_folder

#: The white space of all contracts, and what stands between it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where rows are joined by it.
NO_ID = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application; Spark serves the driver's copy."""
    context = spark.sparkContext
    if not getattr(context, "_editpulse_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='editpulse-')}/editpulse.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        context._editpulse_shipped = True
    return spark


class Scratch:
    """A new folder below the shared one, for the tables between an operator's jobs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(configure(spark))
        # Texts grow several times over in a worker, so it gets few at a time.
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        self.root = run_folder(spark, name)

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame, written and read back, so later jobs don't compute it again."""
        frame.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs with different seeds."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema with more columns behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def tokenizer_file(name: str) -> str:
    """The place of an installed vocabulary; operators take a path, so any other will do."""
    import public_tokenizers

    return public_tokenizers.path(name)
