"""JSON lines and Parquet in and out, file and line numbers, nested keys of raw lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silterra.functions.text import let
from silterra.session import Scratch

LINE_BITS = 32
#: Lines of a file that a task writes at a time.
SLOT = 1 << 13
#: What becomes of a raw line with an id and a mark.
Make = Callable[[Column, Column, Column], Column]


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of JSON lines, compressed ones by their extension. A malformed line is an error. Without a schema one is inferred by a pass over all lines."""
    reader = spark.read.option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _scan(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", name) if name else reader).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("raw"))


def count_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``(path, path_id, ...)`` of each split of the files for ``read_lines``, by one pass over them; windows hold one row for each split."""
    splits = _scan(spark, path, name).groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return Scratch(spark).write(splits.withColumn("path_id", (F.dense_rank().over(Window.orderBy("path")) - 1).cast("long")), "splits")


def read_lines(spark: SparkSession, path: str, name: str | None = None, splits: DataFrame | None = None) -> DataFrame:
    """``(path, path_id, line_num, raw)`` of every line, of files whose name matches the pattern ``name`` if one is given.

    Lines of a file are numbered from 0, whatever splits it is read in, and files from 0 in the order of their names. Lines are counted by split
    in a pass of their own, so no line is moved for its number: the table of splits is broadcast, and the driver plans by such a table anyway.
    """
    splits = count_lines(spark, path, name) if splits is None else splits
    rows = _scan(spark, path, name).join(F.broadcast(splits), ["path", "__block"])
    return rows.select("path", "path_id", (F.col("__before") + F.col("__at") - F.col("__first")).alias("line_num"), "raw")


def content(raw: Column, key: str) -> Column:
    """The string under a top-level key, never null. A line without it or with another type there is an error. A line is parsed once."""
    found = F.variant_get(F.parse_json(raw), f"$['{key}']", "variant")
    text = let(found, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.raise_error(F.lit(f"no string under {key}"))))
    return F.coalesce(text, F.lit(""))


def nested(raw: Column, path: str) -> Column:
    """The JSON text under a dotted path, so that ``1`` and ``"1"`` differ."""
    return F.to_json(F.variant_get(F.parse_json(raw), "$" + "".join(f"['{k}']" for k in path.split(".")), "variant"))


def path_ids(rows: DataFrame, path: str = "path") -> DataFrame:
    """``(path, path_id)``: files numbered from 0 in the order of their names. The window holds one row for each file."""
    return rows.select(path).distinct().withColumn("path_id", (F.dense_rank().over(Window.orderBy(path)) - 1).cast("long"))


def with_path_ids(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with ``path_id``; there is one row for each file in what is broadcast, and the driver lists the files anyway."""
    ids = F.broadcast(path_ids(rows, path).withColumnRenamed(path, "__path"))
    return rows.join(ids, rows[path].eqNullSafe(ids["__path"])).drop("__path")


def path_chunk(rows: DataFrame, chunk: int, chunks: int) -> DataFrame:
    """The rows of the files whose number is ``chunk`` modulo ``chunks``."""
    return rows.where(F.pmod("path_id", F.lit(chunks)) == chunk)


def pack(path_id: Column, line_num: Column) -> Column:
    """One bigint of both, as long as lines are fewer than 2**32 a file and files fewer than 2**31."""
    return F.shiftleft(path_id.cast("long"), LINE_BITS).bitwiseOR(line_num.cast("long"))


def unpack(doc_id: Column) -> tuple[Column, Column]:
    return F.shiftright(doc_id, LINE_BITS), doc_id.bitwiseAND(F.lit((1 << LINE_BITS) - 1))


def with_doc_ids(rows: DataFrame) -> DataFrame:
    """``(path, path_id, line_num, ...)`` with a packed ``doc_id``."""
    return rows.withColumn("doc_id", pack(F.col("path_id"), F.col("line_num")))


def write_jsonl(rows: DataFrame, path: str, compression: str = "none", by: str | None = None) -> None:
    """JSON lines; with ``by`` a folder for each of its values, so an input file without rows has none."""
    writer = rows.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(by) if by else writer).json(path)


def write_lines(rows: DataFrame, path: str, source: str, marks: DataFrame | None = None, make: Make | None = None, names: DataFrame | None = None) -> None:
    """The raw lines of ``(path, path_id, line_num, raw)`` in files named as those in the folder source that they come from, in their order.

    With marks, ``(doc_id, mark)`` of some lines, the line is ``make(raw, doc_id, mark)`` and left out if that is null; the mark of other lines is
    null. Lines and marks meet in the shuffle that brings lines in order, the only one that moves lines. names is a smaller table than rows with the
    same ``(path, path_id)``. A compressed file's name loses its ending.
    A file of more than ``SLOT`` lines is a folder of parts in order; one without lines isn't there.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(conf).makeQualified(root).toUri().getRawPath().rstrip("/") + "/"
    at = F.locate(root, F.col("path"))
    inside = F.when(at > 0, F.substring(F.col("path"), at + len(root), F.length("path"))).otherwise(F.substring_index("path", "/", -1))
    inside = F.regexp_replace(F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))), r"\.(gz|zst|bz2|lz4|snappy|deflate)$", "")
    slot = F.shiftright("line_num", SLOT.bit_length() - 1).alias("__slot")
    lines = rows.select("path_id", slot, "line_num", F.col("raw").alias("value"))
    if marks is None or make is None:
        ordered = lines.repartition("path_id", "__slot").sortWithinPartitions("path_id", "__slot", "line_num")
    else:
        kind = marks.schema["mark"].dataType
        file, line = unpack(F.col("doc_id"))
        notes = marks.select(file.alias("path_id"), line.alias("line_num"), F.struct("mark").alias("__note")).select("path_id", slot, "line_num", F.lit(None).cast("string").alias("value"), "__note")
        both = lines.withColumn("__note", F.lit(None).cast(T.StructType([T.StructField("mark", kind)]))).unionByName(notes)
        # A line's mark comes just before it.
        last = F.lag(F.when(F.col("__note").isNotNull(), F.struct("line_num", "__note.mark"))).over(Window.partitionBy("path_id", "__slot").orderBy("line_num", F.col("__note").isNull()))
        found = both.withColumn("__last", last).where("value is not null")
        mark = F.when(F.col("__last.line_num") == F.col("line_num"), F.col("__last.mark"))
        ordered = found.withColumn("value", make(F.col("value"), pack(F.col("path_id"), F.col("line_num")), mark)).where("value is not null")
    parts = jvm.org.apache.hadoop.fs.Path(path, "_parts")
    fs = parts.getFileSystem(conf)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    ordered.select("path_id", "__slot", "value").write.partitionBy("path_id", "__slot").text(parts.toString())
    named = dict((rows if names is None else names).select("path_id", inside).distinct().collect())
    under = lambda folder, key: sorted((int(x.getPath().getName().removeprefix(key)), x.getPath()) for x in fs.listStatus(folder) if x.getPath().getName().startswith(key))
    for number, folder in under(parts, "path_id="):
        pieces = [x.getPath() for _, slots in under(folder, "__slot=") for x in sorted(fs.listStatus(slots), key=lambda x: x.getPath().getName())]
        target = jvm.org.apache.hadoop.fs.Path(path, named[number])
        fs.mkdirs(target.getParent() if len(pieces) == 1 else target)
        for k, piece in enumerate(pieces):
            fs.rename(piece, target if len(pieces) == 1 else jvm.org.apache.hadoop.fs.Path(target, f"part-{k:08d}.txt"))
    fs.delete(parts, True)
