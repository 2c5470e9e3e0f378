"""Where facts come from: file listings, fact tables, snapshots and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars
from ..schemas import FACTS


def discover_files(spark: SparkSession, path: str, pattern: str = "*.php") -> DataFrame:
    """Paths of the source files below a folder, or the file itself, sorted; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.regexp_replace("path", "^file:(//)?", "").alias("file")).orderBy("file")


def read_facts(spark: SparkSession, base: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The fact tables an extractor wrote; a table that is not there is empty, with its schema."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = {}
    for name, ddl in FACTS.items():
        at = f"{base}/{name}"
        path = jvm_path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        schema = StructType.fromDDL(ddl)
        out[name] = spark.read.schema(schema).format(fmt).load(at) if fs.exists(path) else spark.createDataFrame([], schema)
    return out


def prime(known: DataFrame, more: DataFrame) -> DataFrame:
    """S3: the known files and the new ones, each once, sorted."""
    return known.select("file").union(more.select("file")).where("file is not null").distinct().orderBy("file")


def snapshot_id(files: DataFrame) -> int:
    """Number of known files, which stamps what was derived from them."""
    return files.agg(F.count_distinct("file")).first()[0]


class FactCache:
    """Derived tables kept while the snapshot they were made from is current.

    A changed stamp drops everything. So does a table that would take the kept
    rows above ``most_rows``: no part of what is kept outlives a full cache. A
    table larger than that is made and not kept. Tables that are made while
    another is being made are not kept either, for the other holds their rows.
    """

    def __init__(self, most_rows: int = 100_000):
        self.most_rows, self.stamp, self.kept, self.rows, self.making = most_rows, None, {}, 0, False

    def get(self, stamp: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if stamp != self.stamp:
            self.clear()
            self.stamp = stamp
        if name in self.kept:
            return self.kept[name]
        if self.making:
            return make()
        self.making = True
        try:
            df = make().persist()
            n = df.count()
        finally:
            self.making = False
        if self.rows + n > self.most_rows:
            self.clear()
        if n > self.most_rows:
            return df.unpersist()
        self.kept[name], self.rows = df, self.rows + n
        return df

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept, self.rows = {}, 0


def harvest(nodes: DataFrame) -> dict[str, DataFrame]:
    """One scan of node facts gives methods, closures, first array initialisers and single assignments.

    ``nodes(file, ord, kind, class, name, line, scope_key, var, expr_id, is_array, retires, opaque)``.
    """
    from ..operators import aggregates, windows

    writes = nodes.where(F.col("kind") == "write")
    return {
        "methods": nodes.where(F.col("kind") == "method").select("file", "class", F.col("name").alias("method"), "ord"),
        "closures": closures(nodes.where(F.col("kind") == "closure")),
        "arrays": windows.first_initialisers(writes.where("is_array"), ["file", "scope_key", "var"], F.col("ord")),
        "locals": aggregates.single_assignments(aggregates.opaque_scopes(writes), ["file", "scope_key", "var"]),
    }


def closures(nodes: DataFrame) -> DataFrame:
    """One closure for each start line; the later of two on a line wins."""
    return nodes.groupBy("file", "line").agg(F.max("ord").alias("ord"))


def locate_methods(requests: DataFrame, methods: DataFrame) -> DataFrame:
    """The body of (class, method) in a file, else that of the name alone where only one in the file has it."""
    exact = methods.select(F.col("file").alias("ef"), F.col("class").alias("ec"), F.col("method").alias("em"), F.struct("class", "ord").alias("exact"))
    only = methods.groupBy(F.col("file").alias("of"), F.col("method").alias("om")).agg(F.count("*").alias("n"), F.min(F.struct("class", "ord")).alias("only")).where("n = 1")
    out = requests.join(exact, (F.col("file") == F.col("ef")) & F.col("class").eqNullSafe(F.col("ec")) & (F.col("method") == F.col("em")), "left").join(only, (F.col("file") == F.col("of")) & (F.col("method") == F.col("om")), "left")
    found = F.coalesce("exact", "only")
    return out.select("file", "class", "method", found["class"].alias("found_class"), found["ord"].alias("found_ord"))


def metadata_for(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """The property list of each requested class; an unknown class has an empty one."""
    p = properties.groupBy(F.col("class").alias("pc")).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "type"))).alias("props"))
    empty = F.array().cast("array<struct<ord: int, name: string, type: string>>")
    return requests.distinct().join(p, F.col("class") == F.col("pc"), "left").select("class", F.coalesce("props", empty).alias("props"))


#: Sections of a generated configuration, in order.
CONFIG_SECTIONS = ("includes", "stubFiles", "services", "parameters")


def stub_files(spark: SparkSession, path: str) -> DataFrame:
    """The signature files of a folder, sorted."""
    return discover_files(spark, path, "*.stub")


def config_sink(entries: DataFrame) -> DataFrame:
    """Lines of a generated configuration from (section, value) rows, each once: sections in order, values sorted within.

    Values of ``stubFiles`` are sorted by name, user configuration comes first among ``includes``.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CONFIG_SECTIONS]), F.col("section")).cast("int"), F.lit(0))
    place = F.when(place == 0, len(CONFIG_SECTIONS) + 1).otherwise(place)
    rows = entries.where("value is not null").select("section", "value").distinct()
    return rows.withColumn("place", place).orderBy("place", "section", "value").select("section", "place", F.concat(F.lit("- "), scalars.neon_string(F.col("value"))).alias("line"))


def write_config(entries: DataFrame, path: str) -> None:
    """The configuration as one text file in the folder ``path``, a section's name before its lines."""
    lines = config_sink(entries)
    heads = lines.select("section", "place").distinct().select("place", "section", F.lit(0).alias("at"), F.concat("section", F.lit(":")).alias("value"))
    rows = heads.unionByName(lines.select("place", "section", F.lit(1).alias("at"), F.concat(F.lit("    "), F.col("line")).alias("value")))
    rows.coalesce(1).sortWithinPartitions("place", "section", "at", "value").select("value").write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(section, value) rows of a configuration of that form; none if the file is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "section string, value string")
    # A configuration is one small file, so its lines have one order.
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    head = F.when(F.col("line").rlike("^[^ ].*:$"), F.regexp_extract("line", "^(.*):$", 1))
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("at")))
    text = F.regexp_extract("line", "^    - '(.*)'$", 1)
    return rows.where(F.col("line").startswith("    - ")).select("section", F.replace(text, F.lit("''"), F.lit("'")).alias("value"))
