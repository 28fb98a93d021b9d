"""Readers for the file formats that audits come in. All return lazy DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, by the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def read_csv(spark: SparkSession, path: str, columns: list[str], missing_ok: bool = True) -> DataFrame:
    """A CSV with a header, all columns as strings; those asked for, in this order, empty where absent.

    Quoted line breaks and a byte order mark are understood. A missing file gives no rows, or an error if not missing_ok.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not _exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def read_csv_folders(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """CSVs of many folders, with `folder` and `period`: YYYYMM from the folder's name, else from the whole path."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(pattern, header=True, multiLine=True, escape='"').withColumn("_path", F.input_file_name())
    folder = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    digits = lambda c: F.nullif(F.regexp_extract(c, r"(^|[^0-9])(20[0-9]{4})([^0-9]|$)", 2), F.lit(""))
    out = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in schema.names]
    return raw.select(*out, folder.alias("folder"), F.coalesce(digits(folder), digits(F.col("_path")), F.lit("")).alias("period"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document (array or object); rows that do not fit come with their text in `_corrupt_record`."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines (gzip too): the rows that fit, and (file, line) of those that are no JSON object. Blank lines are skipped."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(F.trim("value") != "")
    is_object = F.json_object_keys("value").isNotNull()
    good = lines.filter(is_object).select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, lines.filter(~F.coalesce(is_object, F.lit(False))).select("file", F.col("value").alias("line"))


def numbered_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, number, line: each line of JSON Lines files that is no JSON object, with its number in the file, from 1.

    Files are split over tasks: lines are counted by split, and each split goes on from the sum of those before it. So no
    line moves but the bad ones. Blank lines count, but are no errors.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    bad = lines.filter((F.trim("value") != "") & F.json_object_keys("value").isNull())
    return bad.join(starts, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), F.col("value").alias("line"))


def read_json_or_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects or JSON Lines, told apart by the first character that is no white space."""
    head = spark.read.text(path).select(F.regexp_extract("value", r"\S", 0).alias("c")).filter("c <> ''").select((F.col("c") == "[").alias("a")).first()
    return spark.read.schema(schema).json(path, multiLine=bool(head and head["a"]), mode="FAILFAST")


def poisoned_keys(bad: DataFrame, pattern: str = "[0-9a-f]{64}") -> DataFrame:
    """The keys that occur in malformed lines; lookups of these must fail."""
    return bad.select(F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("key")).distinct()


def newest_events(spark: SparkSession, pattern: str, schema: str, order: list[str], limit: int) -> DataFrame:
    """The last rows of JSON Lines files, gzip or not, by order."""
    return spark.read.schema(schema).json(pattern).orderBy(*[F.desc(c) for c in order]).limit(max(0, limit))


def read_pipe_dimension(spark: SparkSession, path: str) -> DataFrame:
    """key|number|source|time lines: keys upper-cased, commas dropped, comments, blanks and bad numbers skipped, last wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "t"))
    parts = lines.filter((F.trim("t") != "") & ~F.trim("t").startswith("#")).select("line", F.transform(F.split("t", r"\|"), lambda x: F.trim(x)).alias("p")).filter(F.size("p") >= 2)
    row = parts.select("line", F.upper(F.get("p", F.lit(0))).alias("key"), F.replace(F.get("p", F.lit(1)), F.lit(","), F.lit("")).try_cast("int").alias("number"), F.get("p", F.lit(2)).alias("source"), F.get("p", F.lit(3)).alias("time"))
    last = F.max_by(F.struct("number", "source", "time"), "line").alias("r")
    return row.filter("number is not null").groupBy("key").agg(last).select("key", "r.*")


def read_lines_dimension(spark: SparkSession, path: str, comments: bool = True, upper: bool = True) -> DataFrame:
    """One value a line, trimmed, distinct."""
    v = F.trim("value")
    out = spark.read.text(path).select((F.upper(v) if upper else v).alias("value")).filter("value <> ''")
    return (out.filter(~F.col("value").startswith("#")) if comments else out).distinct()


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), recursive: bool = True, digest: bool = True) -> tuple[DataFrame, DataFrame]:
    """path, size_bytes, modified and (if asked for) content_sha256 of the supported files under root, and the other paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)
    columns = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    return files.filter(known).select(*columns, *([F.sha2("content", 256).alias("content_sha256")] if digest else [])), files.filter(~known).select("path")


def flatten_annotations(tasks: DataFrame, fields: list[str]) -> DataFrame:
    """Annotation tasks (data{image, ocr_meta map}, annotations[]{result[]{from_name, value{choices[], text[]}}}) as flat rows.

    Each field is the first choice, else the first text, of the tagged variant of that name in the first annotation, else
    the default in ocr_meta.
    """
    results = F.get("annotations", F.lit(0))["result"]

    def value(name: str) -> Column:
        one = F.get(F.filter(results, lambda x: x["from_name"] == name), F.lit(0))["value"]
        return F.coalesce(F.get(one["choices"], F.lit(0)), F.get(one["text"], F.lit(0)), F.try_element_at(F.col("data.ocr_meta"), F.lit(name)))

    return tasks.select(F.col("data.image").alias("image"), *[value(f).alias(f) for f in fields])


def explode_products(pages: DataFrame) -> DataFrame:
    """code, price from product lists: the first valid of promotion and list price (1,000 to 1,000,000), for both codes."""
    models = pages.select(F.explode("productList").alias("p")).select(F.explode("p.modelList").alias("m"))
    valid = lambda c: F.when(c.try_cast("int").between(1000, 1_000_000), c.try_cast("int"))
    price = F.coalesce(valid(F.col("m.promotionPrice")), valid(F.col("m.price")))
    return models.select(F.explode(F.array_distinct(F.array_compact(F.array("m.shortCode", "m.fullCode")))).alias("code"), price.alias("price")).filter("price is not null")


def prices_in(html: Column, low: int = 5000, high: int = 30_000) -> Column:
    """Distinct prices in a page's text, ascending: numbers after a currency sign or a price word, in the range."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:NT\$|\$|＄|price|售價|特價)[^0-9]{0,6}([0-9][0-9,]{3,8})"), F.lit(1))
    numbers = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(low, high))))


def page_price(html: Column, full: Column, short: Column, low: int = 1000, high: int = 100_000) -> Column:
    """A model's price on a page, by the first rule that gives one: the first NT$ amount behind the full model name, behind the
    short one, behind the short one's first eight characters, each if it lies between low and high; else the offer's price
    in the page's structured data, whatever it is. Letters match in either case; null without any."""
    upper = F.upper(html)

    def behind(token: Column) -> Column:
        at = F.call_function("instr", upper, F.upper(token))
        amount = F.replace(F.regexp_extract(F.substring(html, at, F.length(html)), r"(?i)NT\$\s*([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("int")
        return F.when((at > 0) & (token != "") & (amount > low) & (amount < high), amount)

    data = F.regexp_extract(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    offer = F.get_json_object(data, "$.offers.price").try_cast("double").cast("int")
    return F.coalesce(behind(full), behind(short), behind(F.substring(short, 1, 8)), offer)
