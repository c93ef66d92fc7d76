"""Raw log directories and label files: scan, number, match, join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.functions.labels import MARK, STRICT
from logwarden.functions.text import not_blank
from logwarden.session import stored
from logwarden.sources.hidden import hidden_files, hidden_lines

# Name endings that stand for a text/* media type.
TEXT_ENDINGS = (
    "txt text css csv htm html md markdown py c h bat ksh pl rtx rtf tsv "
    "sgm sgml vcf vtt srt etx xml n3 js mjs"
).split()
HEAD_BYTES = 1024


# ---------------------------------------------------------------- file lists
def path_parts(rel: Column | str) -> dict[str, Column]:
    """Directory, name, stem and suffix of a relative path."""
    rel = F.col(rel) if isinstance(rel, str) else rel
    name = F.regexp_extract(rel, r"([^/]*)$", 1)
    has_suffix = name.rlike(r"^.+\.[^.]+$")
    return {
        "dir": F.regexp_extract(rel, r"^(.*)/[^/]*$", 1),
        "name": name,
        "stem": F.when(has_suffix, F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name),
        "suffix": F.when(has_suffix, F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(F.lit("")),
    }


def record_key(rel: Column | str) -> Column:
    """Parent directories joined by ``_``, then the stem."""
    p = path_parts(rel)
    return F.when(p["dir"] == "", p["stem"]).otherwise(
        F.concat(F.replace(p["dir"], F.lit("/"), F.lit("_")), F.lit("_"), p["stem"])
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(uri, path, rel, length)`` of all files below ``root``; dot files are left out.

    The binary source is asked for no content column, so nothing is read. Spark
    leaves out files of length zero, which hold no lines. Names that Spark's readers
    hide, such as ``_app.log``, are listed on their own.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("path").alias("uri"), plain_path(F.col("path")).alias("path"), "length")
    )
    unseen = hidden_files(spark, root)
    if unseen:
        more = spark.createDataFrame(unseen, "uri string, length long")
        files = files.unionByName(more.withColumn("path", plain_path(F.col("uri"))))
    base = qualified(spark, root)
    below = F.substring(F.col("path"), len(base) + 2, 1 << 30)
    rel = F.when(F.startswith("path", F.lit(base + "/")), below).otherwise(F.regexp_extract("path", "([^/]*)$", 1))
    return files.withColumn("rel", rel).where(~F.startswith(path_parts("rel")["name"], F.lit(".")))


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as an absolute path, spelled like the paths of :func:`plain_path`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "/", store.makeQualified(path).toString()).rstrip("/")


def head_is_text(head: Column) -> Column:
    """No NUL among the first 1,024 bytes; an empty head is text."""
    return F.position(F.lit(b"\x00"), F.substring(head, 1, HEAD_BYTES)) == 0


def has_text_ending(rel: Column | str) -> Column:
    ending = F.lower(F.ltrim(path_parts(rel)["suffix"], F.lit(".")))
    return ending.isin(*TEXT_ENDINGS)


def text_files(files: DataFrame, root: str) -> DataFrame:
    """``(path, rel)`` of the files that hold text, by name ending or first kilobyte.

    The kilobyte is that of Spark's own scan: of a file's first split, the lines
    that begin in it (1,024 at most) are looked through for a NUL.
    """
    unsure = files.where(~has_text_ending("rel")).select("path")
    lines = (
        files.sparkSession.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
        .select(
            scanned_path().alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("rid"),
            F.col("value").cast("binary").alias("value"),
        )
        .where("start = 0")
    )
    unseen = hidden_files(files.sparkSession, root)
    if unseen:
        heads = hidden_lines(files.sparkSession, [(uri, min(n, HEAD_BYTES)) for uri, n in unseen])
        lines = lines.unionByName(heads.select(plain_path(F.col("uri")).alias("path"), "start", F.col("i").alias("rid"), "value"))
    lines = lines.join(unsure, "path", "left_semi")
    order = Window.partitionBy("path").orderBy("rid")
    first = lines.withColumn("i", F.row_number().over(order)).where(F.col("i") <= HEAD_BYTES)
    before = F.sum(F.octet_length("value") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    nul = F.position(F.lit(b"\x00"), F.col("value"))
    binary = (
        first.withColumn("at", F.coalesce(before, F.lit(0)) + nul)
        .where((nul > 0) & (F.col("at") <= HEAD_BYTES)).select("path").distinct()
    )
    return files.join(binary, "path", "left_anti").select("path", "rel")


# -------------------------------------------------------------- line scanning
BROADCAST_SPLITS = 100_000  # rows of a few hundred bytes


def log_lines(spark: SparkSession, root: str, numbering: str = "raw", files: DataFrame | None = None) -> DataFrame:
    """``(path, line_no, log)`` for every non-blank line below ``root``.

    Large files are read in splits by many tasks. Row ids grow by one inside a
    split, so a line's place in its split is a subtraction; one small aggregate
    per (file, split) and a running sum over the splits of a file give the
    offset of each split. No line is sorted or shuffled for its number: the
    table of splits is broadcast when it has been counted as small enough.

    Files that Spark's readers hide are read by ``hidden`` and numbered alike.

    ``numbering="raw"`` counts all lines as label files do, ``"compact"`` counts
    the non-blank ones only. With ``files``, only lines of its paths are kept and
    its other columns come along, by way of the splits.
    """
    pin_scan_layout(spark)
    scanned = (
        spark.read.option("recursiveFileLookup", "true")
        .text(root)
        .select(
            scanned_path().alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.make_valid_utf8("value").alias("log"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    unseen = hidden_files(spark, root)
    if unseen:
        more = hidden_lines(spark, unseen)
        scanned = scanned.unionByName(
            more.select(plain_path(F.col("uri")).alias("path"), "start", F.make_valid_utf8("value").alias("log"), F.col("i").alias("rid"))
        )
    kept = scanned.where(not_blank(F.col("log")))
    counted = kept if numbering == "compact" else scanned
    splits = split_offsets(
        counted.groupBy("path", "start").agg(F.min("rid").alias("first"), F.count("*").alias("n"))
    )
    if files is not None:
        splits = splits.join(files, "path")
    splits = stored(splits.drop("n"), "splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    if numbering == "compact":
        # blank lines leave gaps in the row ids, so the place in the split is a
        # rank; its window is one split, at most one read partition
        place = F.row_number().over(Window.partitionBy("path", "start").orderBy("rid"))
    else:
        place = F.col("rid") - F.col("first") + 1
    numbered = kept.join(splits, ["path", "start"]).withColumn(
        "line_no", (F.col("before") + place).cast("bigint")
    )
    extra = [c for c in files.columns if c != "path"] if files is not None else []
    return numbered.select("path", "line_no", "log", *extra)


def pin_scan_layout(spark: SparkSession) -> None:
    """Keeps the cutting of files into splits the same for every scan of the
    session, also when executors come and go between two scans."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def plain_path(path: Column) -> Column:
    """One spelling of local paths, whose scheme readers write differently."""
    return F.regexp_replace(path, "^file:/+", "/")


def scanned_path() -> Column:
    """The path of a scanned row's file, without the escapes of a URI."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return plain_path(F.url_decode(escaped))


def split_offsets(splits: DataFrame) -> DataFrame:
    """Adds ``before``: lines of the same file in earlier splits (one row per split)."""
    earlier = (
        Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    return splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")))


# ------------------------------------------------------------------ label files
LABEL_ROW = "struct<line: bigint, labels: string>"


def parse_label_rows(rows: DataFrame) -> DataFrame:
    """``(path, line_no, y)`` from JSON text rows ``(path, pos, value)``.

    Rows that are not objects or lack a key are skipped one by one; of several
    rows for a line the last one wins. ``y`` is the JSON text of the labels.
    """
    keys = F.json_object_keys("value")
    # parsed as the element before an end mark, so that text after the object is refused
    end = F.lit(f',{{"line":0,"labels":"{MARK}"}}]')
    whole = F.from_json(F.concat(F.lit("["), F.col("value"), end), f"array<{LABEL_ROW}>", STRICT)
    item = F.when((F.size(whole) == 2) & (F.get(whole, F.lit(1))["labels"] == MARK), F.get(whole, F.lit(0)))
    return (
        rows.where(F.array_contains(keys, "line") & F.array_contains(keys, "labels"))
        .select("path", "pos", item.alias("item"))
        .where("item.line is not null")
        .groupBy("path", F.col("item.line").alias("line_no"))
        .agg(F.max_by(F.coalesce("item.labels", F.lit("null")), "pos").alias("y"))
    )


def label_lines(spark: SparkSession, root: str) -> DataFrame:
    """Label rows of every file below ``root``, keyed by file and line."""
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .text(root)
        .select(
            scanned_path().alias("path"),
            F.struct(
                F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
            ).alias("pos"),
            F.make_valid_utf8("value").alias("value"),
        )
    )
    return parse_label_rows(rows)


def match_label_files(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(log_rel, label_rel)``: the label file of each log file, if there is one.

    A label file fits when its name starts with the log's stem. Preferred are an
    equal suffix, then numeric suffixes on both sides, then any; each time the
    log's own directory first, then path order.

    Both lists are turned into probe keys, so this is an equi-join against one
    row per key: names with many namesakes never form pairs.
    """
    lab = path_parts("rel")
    label_side = labels.select(
        "rel",
        lab["dir"].alias("dir"),
        lab["suffix"].alias("suffix"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length(lab["name"])),
                lambda n: F.substring(lab["name"], F.lit(1), n),
            )
        ).alias("prefix"),
    )
    label_numeric = F.col("suffix").rlike(r"^\.\d+$")
    keyed = label_side.select(
        "rel",
        F.explode(
            F.array_compact(
                F.array(
                    F.to_json(F.struct(F.lit("sd").alias("k"), "prefix", "suffix", "dir")),
                    F.to_json(F.struct(F.lit("s").alias("k"), "prefix", "suffix")),
                    F.when(label_numeric, F.to_json(F.struct(F.lit("nd").alias("k"), "prefix", "dir"))),
                    F.when(label_numeric, F.to_json(F.struct(F.lit("n").alias("k"), "prefix"))),
                    F.to_json(F.struct(F.lit("ad").alias("k"), "prefix", "dir")),
                    F.to_json(F.struct(F.lit("a").alias("k"), "prefix")),
                )
            )
        ).alias("key"),
    )
    best = keyed.groupBy("key").agg(F.min("rel").alias("label_rel"))

    log = path_parts("rel")
    log_side = logs.select(
        F.col("rel").alias("log_rel"),
        log["dir"].alias("dir"),
        log["stem"].alias("prefix"),
        log["suffix"].alias("suffix"),
    )
    log_numeric = F.col("suffix").rlike(r"^\.\d+$")
    probes = log_side.select(
        "log_rel",
        F.posexplode(
            F.array_compact(
                F.array(
                    F.to_json(F.struct(F.lit("sd").alias("k"), "prefix", "suffix", "dir")),
                    F.to_json(F.struct(F.lit("s").alias("k"), "prefix", "suffix")),
                    F.when(log_numeric, F.to_json(F.struct(F.lit("nd").alias("k"), "prefix", "dir"))),
                    F.when(log_numeric, F.to_json(F.struct(F.lit("n").alias("k"), "prefix"))),
                    F.to_json(F.struct(F.lit("ad").alias("k"), "prefix", "dir")),
                    F.to_json(F.struct(F.lit("a").alias("k"), "prefix")),
                )
            )
        ).alias("rank", "key"),
    )
    return (
        probes.join(best, "key", "left")
        .groupBy("log_rel")
        .agg(
            F.min_by("label_rel", F.when(F.col("label_rel").isNotNull(), F.col("rank"))).alias(
                "label_rel"
            )
        )
    )


def join_labels(lines: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of lines with label rows; lines without one get ``[]``."""
    return lines.join(labels, keys, "left").withColumn("y", F.coalesce("y", F.lit("[]")))
