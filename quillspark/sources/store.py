"""A versioned store of Parquet tables: a version is a folder, and a small file NEXT-<version> names the one that follows it.

That file is moved to its name in one step, which fails if another writer has been there: of several writers that start from one version
only one gets through. CURRENT says where to begin to look; it is replaced in one step and may lag, which costs a look at NEXT files and
nothing else. Readers see whole versions only, at any time. Upserts and deletes are joins against the current version.

Every version has the schemas of its tables beside them, in a file SCHEMAS. `ensured` compares them with what a program expects, and has all tables of
a version built anew, together, where they differ: readers see the old version until the new one is complete, and never a part of each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.text import stable_row_id


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def deleted(table: DataFrame, keys_gone: DataFrame, key: str) -> DataFrame:
    return table.join(keys_gone.select(key).distinct(), key, "left_anti")


def cascade_deleted(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents and their children."""
    return deleted(parents, gone, key), children.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A registry that holds exactly the new rows; a key that occurs twice is an error."""
    if new.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{keys} occur more than once")
    return upserted(old.join(new.select(*keys), keys, "left_semi"), new, keys)


def keep_latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest(snapshots: DataFrame, kind: str, n: int, key: str = "id", column: str = "type") -> DataFrame:
    """The last n snapshots of a kind, the newest first."""
    return snapshots.filter(F.col(column) == kind).orderBy(F.col(key).desc()).limit(max(0, n))


def rewritten_timestamps(table: DataFrame, columns: list[str], pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> tuple[DataFrame, DataFrame]:
    """(table with its timestamp texts in one form, per column: scanned, updated, skipped_null, unchanged). Unreadable texts stay."""
    new = {c: F.coalesce(F.date_format(F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))), pattern), F.col(c)) for c in columns}
    readable = {c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))).isNotNull() for c in columns}
    count = lambda cond: F.count(F.when(cond, 1))
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("scanned"), count(readable[c] & (new[c] != F.col(c))).alias("updated"), count(~F.coalesce(readable[c], F.lit(False))).alias("skipped_null"), count(readable[c] & (new[c] == F.col(c))).alias("unchanged")) for c in columns]
    return table.withColumns(new), table.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def row_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.withColumn("row_id", stable_row_id(F.col(key)))


def as_struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def fields_of(schema: StructType) -> dict[str, str]:
    """column -> type, in order. Whether a column may be null is not part of it: files that were read back don't say."""
    return {f.name: f.dataType.simpleString() for f in schema.fields}


class Store:
    """Tables below a folder that Spark can read and write. Writers don't have to know of each other: the second one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        """(file context, path) of a file in the store's folder."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.getFileSystem(conf).getUri(), conf), p

    def _text(self, name: str) -> str | None:
        context, p = self._at(name)
        if not context.util().exists(p):
            return None
        stream = context.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, over: bool) -> bool:
        """A small file, whole or not at all; False if it is there already and must not be replaced."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, rename = jvm.org.apache.hadoop.fs, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context, p = self._at(name)
        folder, _, file = name.rpartition("/")
        _, temporary = self._at(f"{folder}{'/' if folder else ''}.{file}-{uuid.uuid4().hex}")
        flags = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
        options = gateway.new_array(getattr(fs, "Options$CreateOpts"), 1)
        options[0] = getattr(fs, "Options$CreateOpts").createParent()
        out = context.create(temporary, flags, options)
        out.write(bytearray(text.encode()))
        out.close()
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if over else rename.NONE
        try:
            context.rename(temporary, p, how)
        except Py4JJavaError as e:
            context.delete(temporary, False)
            if over or "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def version(self) -> str | None:
        now, after = self._text("CURRENT"), None
        while after := self._text(f"NEXT-{now or 'none'}"):
            now = after
        return now

    def read(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version or self.version()}/{name}")

    def write(self, tables: dict[str, DataFrame], expect: str | None = None) -> str:
        """A new version with these tables; fails if the current version isn't `expect` any more (None: there is none yet)."""
        new = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{new}/{name}")
        self._put(f"{new}/SCHEMAS", json.dumps({name: fields_of(df.schema) for name, df in tables.items()}), over=False)
        if self.version() != expect or not self._put(f"NEXT-{expect or 'none'}", new, over=False):
            raise RuntimeError("another writer has come first")
        self._put("CURRENT", new, over=True)
        return new

    def schemas(self, version: str | None = None) -> dict[str, dict[str, str]]:
        """table -> column -> type of a version (the current one); empty without a version, or for one that was written without SCHEMAS."""
        version = version or self.version()
        text = self._text(f"{version}/SCHEMAS") if version else None
        return json.loads(text) if text else {}

    def drift(self, expected: dict[str, str | StructType], version: str | None = None) -> dict[str, tuple[dict | None, dict]]:
        """table -> (columns as stored, or None without the table; columns as expected) for every expected table that is not as it should be. Order and
        names of columns, their case and their types count."""
        found = self.schemas(version)
        wanted = {name: fields_of(as_struct(schema)) for name, schema in expected.items()}
        return {name: (found.get(name), columns) for name, columns in wanted.items() if list(found.get(name, {"": ""}).items()) != list(columns.items())}

    def ensured(self, expected: dict[str, str | StructType], build: Callable[[], dict[str, DataFrame]]) -> tuple[str, bool]:
        """(version, whether it was built): the current version if its tables have the expected schemas, else one with all tables that build() gives.
        What is built has to be as expected, too; if it isn't, or building fails, the current version stays. Of several that rebuild one gets through."""
        now = self.version()
        if now and not self.drift(expected, now):
            return now, False
        tables = build()
        for name, schema in expected.items():
            columns = fields_of(as_struct(schema))
            if name not in tables or list(fields_of(tables[name].schema).items()) != list(columns.items()):
                raise ValueError(f"what was built for {name} is not as expected: {fields_of(tables[name].schema) if name in tables else None}")
        return self.write(tables, expect=now), True

    def log(self, run: DataFrame) -> None:
        """Appends one run to the ingest log, which versions share."""
        run.write.mode("append").parquet(f"{self.path}/ingest_log")
