"""Text sources of program facts: Java trees, call graphs, method ids, logs and side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of files and folders that a source scan leaves out (fixed values).
EXCLUDED = ("test", "package-info.java", "module-info.java", "annotations", "annotation", ".m2")


def java_sources(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of all Java files below ``root``; path is relative."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").text(root, wholetext=True)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    path = F.regexp_replace(full, "^.*?" + root.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")
    rows = files.select(path.alias("path"), F.col("value").alias("text"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED))))


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, line, value, offset)``: lines from 0 and the byte at which each begins."""
    split = files.select(path, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    before = Window.partitionBy(path).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("offset", F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)))


def method_id(text: Column) -> Column:
    """``[static] pkg.Outer.Class#name(types)`` as a struct: package, class_name, method_name, is_static, arg_types."""
    body = F.regexp_replace(F.trim(text), r"^static\s+", "")
    owner = F.split(F.substring_index(body, "#", 1), r"\.")
    first = F.coalesce(F.array_position(F.transform(owner, lambda p: p.rlike("^[A-Z]")), True), F.lit(0)).cast("int")
    cut = F.when(first == 0, F.size(owner) + 1).otherwise(first)
    types = F.trim(F.regexp_extract(body, r"\(([^)]*)\)", 1))
    return F.struct(
        F.slice(owner, F.lit(1), cut - 1).alias("package"),
        F.array_join(F.slice(owner, cut, F.size(owner)), "$").alias("class_name"),
        F.regexp_extract(body, r"#([^(]*)", 1).alias("method_name"),
        F.trim(text).rlike(r"^static\s").alias("is_static"),
        F.when(types == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(types, r"\s*,\s*"), lambda t: F.element_at(F.split(t, r"\."), -1))).alias("arg_types"),
    )


def method_text(method: Column) -> Column:
    """The canonical string of a method id."""
    owner = F.concat_ws(".", method["package"], method["class_name"])
    return F.concat(F.when(method["is_static"], "static ").otherwise(""), owner, F.lit("#"), method["method_name"], F.lit("("), F.array_join(method["arg_types"], ","), F.lit(")"))


def call_graph(numbered: DataFrame, order: list[str], by: list[str], value: str = "value") -> DataFrame:
    """``(caller, callee)`` of lines ``CALLER: id`` and, indented below, ``CALLEE: id``.

    ``numbered`` has the lines in ``order``; ``by`` names the columns that keep files apart, each file one group. A callee belongs to the last caller above it.
    """
    caller = F.regexp_extract(value, r"^\s*CALLER:\s*(.*?)\s*$", 1)
    callee = F.regexp_extract(value, r"^\s*CALLEE:\s*(.*?)\s*$", 1)
    window = Window.partitionBy(*by).orderBy(*order)
    filled = numbered.withColumn("caller", F.last(F.when(caller != "", caller), ignorenulls=True).over(window)).withColumn("callee", callee)
    return filled.where("callee != '' AND caller IS NOT NULL").select(*by, "caller", "callee").distinct()


def known_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls whose both ends have a source, by ``methods(method)``."""
    return calls.join(methods.select(F.col("method").alias("caller")), "caller", "left_semi").join(methods.select(F.col("method").alias("callee")), "callee", "left_semi").select("caller", "callee")


def compatible_callees(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """Call sites ``(site, name, n_args, is_ctor)`` with the methods they may call.

    ``methods(method, method_name, n_formals, varargs)``: names are equal (a constructor calls
    ``<init>``), and the arity is, or may be by a variable last argument.
    """
    m = methods.select(F.col("method").alias("callee"), F.col("method_name").alias("key"), "n_formals", "varargs")
    keyed = sites.withColumn("key", F.when(F.col("is_ctor"), "<init>").otherwise(F.col("name")))
    fits = (F.col("n_args") == F.col("n_formals")) | F.col("varargs") & (F.col("n_args") >= F.col("n_formals") - 1)
    return keyed.join(m, "key").where(fits).select("site", "callee")


def latency_log(spark: SparkSession, path: str) -> DataFrame:
    """``(path, edit_no, ms)``: one float a line, in file order."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("edit_no", "line"))
    return text.where(F.trim("line") != "").select("path", F.col("edit_no").cast("long"), F.col("line").cast("double").alias("ms"))


def stats_lines(files: DataFrame) -> DataFrame:
    """``(path, values)`` for the last three lines without ``SUMMARIES`` of each log: the whole numbers of their ``[STATS]``."""
    kept = lines(files).where(~F.col("value").contains("SUMMARIES") & (F.trim("value") != ""))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line")))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace("value", r"^.*\[STATS\]", ""), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return kept.withColumn("rank", last).where("rank <= 3").groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", numbers.alias("n")))), lambda r: r["n"])).alias("values"))


def side_file(spark: SparkSession, path: str) -> DataFrame:
    """``(name, value)`` of lines ``name : number``; other lines are headers."""
    rows = spark.read.text(path)
    return rows.select(F.regexp_extract("value", r"^\s*(.*?)\s*:\s*\d+\s*$", 1).alias("name"), F.regexp_extract("value", r":\s*(\d+)\s*$", 1).alias("number")).where("number != ''").select("name", F.col("number").cast("long").alias("value"))


def bytes_at(text: Column, start: Column | int, length: Column | int) -> Column:
    """The bytes of a text from a byte position (from 0), as they stand."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return text.cast("binary").substr((start + 1).cast("int"), length.cast("int"))


def is_entry_point(method: Column, class_name: str | None = None, package: list[str] | None = None) -> Column:
    """Whether a method id is a main, of a class and package if they are given."""
    found = method["method_name"] == "main"
    if class_name is not None:
        found = found & (method["class_name"] == class_name)
    return found if package is None else found & (F.concat_ws(".", method["package"]) == ".".join(package))


def library_kind(name: Column, n_args: Column) -> Column:
    """What a library method without a source is taken for: constructor, getter, setter, one without effect, or unknown."""
    return (
        F.when(name == "<init>", "constructor")
        .when(name.isin("println", "print", "printf", "format", "equals", "hashCode", "toString"), "no_effect")
        .when(name.rlike("^(get|is|has)[A-Z]") & (n_args == 0), "getter")
        .when(name.rlike("^set[A-Z]") & (n_args == 1), "setter")
        .otherwise("unknown")
    )


def query_ids(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(text, method)`` of a file with a method id on each line; empty lines and comments (#) are none."""
    text = F.trim(value)
    rows = lines.where((text != "") & ~text.startswith("#")).select(text.alias("text"))
    return rows.withColumn("method", method_id(F.col("text")))


def form_counts(unsupported: DataFrame) -> DataFrame:
    """``(form, n)``: how often each unsupported form occurs."""
    return unsupported.groupBy("form").agg(F.count("*").alias("n"))
