"""Tables of which a change is seen whole or not at all, and fixtures that are verified before they are read.

A store is a folder with a log and data. A version is one file of the log, which names for each table and bucket of keys the
folder that holds its rows; files never change once written. A change writes the buckets that it touches to new folders and then
adds the next version: several tables change together, a reader keeps the version it began with, and of two writers that
begin at the same version one is refused. What a writer leaves that is refused or lost is named by no version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class Conflict(ValueError):
    """Another writer was first."""


def _files(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder: the one Spark reads and writes it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole, or FileExistsError if there is one of its name."""
    files, target = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{target.getParent().toString()}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(kinds, 1)
    never_over[0] = kinds.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, never_over)
    except Exception as e:
        files.delete(draft, False)
        if files.exists(target):
            raise FileExistsError(path) from e
        raise


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def head(self) -> int:
        """The newest version; 0 before the first."""
        files, log = _files(self.spark, f"{self.folder}/_log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _entry(self, version: int) -> dict:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/_log/{version:020d}.json", wholetext=True).first()[0])

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._entry(self.head() if version is None else version))

    def keys(self, name: str) -> list[str]:
        return self._entry(self.head())[name]["keys"]

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, name: str, version: int | None = None, touched: list[int] | None = None) -> DataFrame:
        """A table as a version has it, or some of its buckets."""
        table = self._entry(self.head() if version is None else version)[name]
        places = [f"{self.folder}/{where}/{_BUCKET}={b}" for b, where in table["buckets"].items() if touched is None or int(b) in touched]
        schema = self.spark.createDataFrame([], table["schema"]).schema
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def commit(self, base: int, changes: dict[str, tuple[DataFrame, list[str], list[int] | None]]) -> int:
        """Makes version base + 1. changes: table -> rows, keys, and the buckets that rows are the whole of (None: the table)."""
        entry, mark = self._entry(base), uuid.uuid4().hex
        for name, (rows, keys, touched) in changes.items():
            where = f"data/{name}/{mark}"
            dealt = rows.withColumn(_BUCKET, self._bucket(keys)).repartition(_BUCKET, *[F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(8))])
            dealt.write.partitionBy(_BUCKET).parquet(f"{self.folder}/{where}")
            files, path = _files(self.spark, f"{self.folder}/{where}")
            made = {s.getPath().getName().removeprefix(f"{_BUCKET}="): where for s in files.listStatus(path) if s.isDirectory()}
            kept = {} if touched is None else {b: w for b, w in entry[name]["buckets"].items() if int(b) not in touched}
            entry[name] = {"keys": keys, "schema": ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), "buckets": kept | made}
        try:
            publish(self.spark, f"{self.folder}/_log/{base + 1:020d}.json", json.dumps(entry))
        except FileExistsError as e:
            raise Conflict(f"version {base + 1} is another writer's") from e
        return base + 1

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """Buckets that the keys of rows are in; no more than the store has."""
        return sorted(r[0] for r in rows.select(self._bucket(keys)).distinct().collect())


def patch_faults(current: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, fault: patch rows whose key is unknown, comes twice, or whose before_<column> is not what is stored."""
    there = current.select(*keys, *(F.col(c).alias(f"_now_{c}") for c in columns), F.lit(True).alias("_there"))
    counted = patch.groupBy(*keys).agg(F.count("*").alias("_times"), *(F.any_value(f"before_{c}").alias(f"before_{c}") for c in columns))
    moved = F.lit(False)
    for c in columns:
        moved = moved | ~F.col(f"_now_{c}").eqNullSafe(F.col(f"before_{c}"))
    fault = F.when(F.col("_times") > 1, "comes twice").when(F.col("_there").isNull(), "no such row").when(moved, "stored value has moved")
    return counted.join(there, keys, "left").select(*keys, fault.alias("fault")).filter("fault IS NOT NULL")


def patched(current: DataFrame, patch: DataFrame, keys: list[str], columns: list[str], drop: str | None = None) -> DataFrame:
    """current with after_<column> where a patch row says so; rows whose patch says ``drop`` go."""
    after = patch.select(*keys, *(F.col(f"after_{c}") for c in columns), (F.col(drop) if drop else F.lit(False)).alias("_drop"), F.lit(True).alias("_hit"))
    both = current.join(after, keys, "left").filter("NOT coalesce(_drop, false)")
    return both.select(*(F.when(F.col("_hit"), F.col(f"after_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def repair(store: Store, patches: dict[str, tuple[DataFrame, list[str]]], drop: str = "drop") -> int:
    """Applies patches of several tables as one version, or raises and leaves all as it was.

    patches: table -> rows (the table's keys, before_<column> and after_<column> for each column, ``drop`` if rows may go), columns.
    Only buckets that hold patched rows are read and written again."""
    base, changes, faults = store.head(), {}, []
    entry = store._entry(base)
    for name, (patch, columns) in patches.items():
        keys = entry[name]["keys"]
        touched = store.touched(patch, keys)
        current = store.read(name, base, touched)
        found = patch_faults(current, patch, keys, columns).limit(5).collect()
        faults += [(name, *r) for r in found]
        changes[name] = (patched(current, patch, keys, columns, drop if drop in patch.columns else None), keys, touched)
    if faults:
        raise ValueError(f"nothing was changed: {faults}")
    return store.commit(base, changes) if changes else base


def append_together(store: Store, arriving: dict[str, DataFrame], parents: dict[str, tuple[str, str]] | None = None) -> int:
    """Appends rows of several tables as one version: parents with their children, or nothing.

    parents: table -> (parent table, column that names a row of it by its only key); what is appended counts as a parent."""
    from hearsay.operators.doors import insert_faults

    base, changes, faults = store.head(), {}, []
    entry = store._entry(base)
    for name, rows in arriving.items():
        keys = entry[name]["keys"]
        touched = store.touched(rows, keys)
        stored = store.read(name, base, touched)
        known = None
        if name in (parents or {}):
            above, column = parents[name]
            key = F.col(entry[above]["keys"][0]).alias(column)
            known = store.read(above, base).select(key)
            known = known.unionByName(arriving[above].select(key)) if above in arriving else known
        found = insert_faults(stored, rows, keys, known, parents[name][1] if known is not None else None)
        faults += [(name, *r) for r in found.limit(5).collect()]
        changes[name] = (stored.unionByName(rows), keys, touched)
    if faults:
        raise ValueError(f"nothing was appended: {faults}")
    return store.commit(base, changes)


def export_fixture(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]], pins: list[tuple[str, DataFrame, DataFrame]] = (), rows_per_file: int = 100_000) -> None:
    """Tables as JSON Lines with a manifest of each file's rows, bytes and sha256, which is written last: before it, there is no
    fixture. pins: (name, recorded, fresh) results that must be equal, or nothing is written."""
    spark = next(iter(tables.values())).sparkSession
    for name, recorded, fresh in pins:
        columns = sorted(recorded.columns)
        differing = recorded.select(*columns).exceptAll(fresh.select(*columns)).limit(1).collect() or fresh.select(*columns).exceptAll(recorded.select(*columns)).limit(1).collect()
        if differing:
            raise ValueError(f"{name} is not what was recorded: {tuple(differing[0])}")
    mark = uuid.uuid4().hex
    for name, rows in tables.items():
        keys = order[name]
        line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
        dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        dealt.select(line).write.option("maxRecordsPerFile", rows_per_file).text(f"{folder}/{mark}/{name}")
    names = sorted(tables)
    found = _digests(spark, f"{folder}/{mark}", names)
    schemas = {n: ", ".join(f"`{c}` {t}" for c, t in tables[n].dtypes) for n in names}
    found.write.mode("errorifexists").json(f"{folder}/{mark}/_digests")
    publish(spark, f"{folder}/manifest.json", json.dumps({"data": mark, "schemas": schemas}))


def _digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """table, file, bytes, rows, sha256 of the files there; a file is as large as rows_per_file lets it be."""
    found = None
    for n in names:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{n}")
        own = raw.select(
            F.lit(n).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
            (F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).cast("long").alias("rows"), F.sha2("content", 256).alias("sha256"),
        )
        found = own if found is None else found.unionByName(own)
    return found


def fixture_faults(spark: SparkSession, folder: str) -> DataFrame:
    """table, file, fault: files that are lost, changed, or that the manifest doesn't name."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    at = f"{folder}/{manifest['data']}"
    named = spark.read.schema("table string, file string, bytes long, rows long, sha256 string").json(f"{at}/_digests").select("table", "file", F.col("sha256").alias("want"))
    there = _digests(spark, at, sorted(manifest["schemas"])).select("table", "file", "sha256")
    fault = F.when(F.col("sha256").isNull(), "lost").when(F.col("want").isNull(), "not in the manifest").when(F.col("want") != F.col("sha256"), "its bytes have changed")
    return named.join(there, ["table", "file"], "full").select("table", "file", fault.alias("fault")).filter("fault IS NOT NULL")


def load_fixture(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a fixture whose files are all as the manifest says; else ValueError names some that are not."""
    found = fixture_faults(spark, folder).orderBy("table", "file").limit(5).collect()
    if found:
        raise ValueError(f"the fixture is damaged: {[tuple(r) for r in found]}")
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    at = f"{folder}/{manifest['data']}"
    return {n: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{at}/{n}") for n, schema in manifest["schemas"].items()}
