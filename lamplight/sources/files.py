"""Readers of solution trees, tables, JSON documents and source lists. Paths are those of any file system Spark knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamplight.functions.text import folder

EXTENSIONS = {"cpp": "cpp", "java": "java", "py": "python", "sql": "sql", "ts": "typescript"}


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that are there, sorted by name; the pattern may have wildcards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    hits = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in hits) if hits else []


def required(spark: SparkSession, path: str, hint: str) -> str:
    """SRC15: the path, if something is there; else an error that says what to do."""
    if not found(spark, path):
        raise FileNotFoundError(f"{path} isn't there: {hint}")
    return path


def newest(spark: SparkSession, pattern: str) -> str | None:
    """T7, SRC11: the last path by name; None if there is none."""
    return max(found(spark, pattern), default=None)


def folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC2, F2: name, parallel_id and title of each folder in root; the last two are null, and skipped is true, where the
    name is not '{number}. {title}'. Files in root are none of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(x.getPath().getName() for x in listed if x.isDirectory())
    x = spark.createDataFrame([(n,) for n in names], "name string").withColumn("f", folder("name"))
    return x.select("name", "f.parallel_id", "f.title", F.col("f").isNull().alias("skipped"))


def solution_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC3: parallel_id, title, language and code of the files '{id}. {title}/{id}.{ext}', where the id of the file is
    written without leading zeros; bytes that aren't UTF-8 are an error, line ends become newlines."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    form = r"/(\d+)\. ([^/]+)/(\d+)\.(\w+)$"
    part = [F.regexp_extract("path", form, i) for i in (1, 2, 3, 4)]
    x = f.where(F.col("path").rlike(form) & part[3].isin(*EXTENSIONS) & (part[0].cast("long").cast("string") == part[2]))
    code = F.regexp_replace(F.validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return x.select(part[0].cast("long").alias("parallel_id"), part[1].alias("title"), F.create_map(*[F.lit(y) for p in EXTENSIONS.items() for y in p])[part[3]].alias("language"), code.alias("code"))


def solution_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC2-SRC4: parallel_id, title and one column a language; a row for each folder, those without files included."""
    langs = list(EXTENSIONS.values())
    own = folders(spark, root).where("NOT skipped").select("parallel_id", "title")
    return own.join(solution_files(spark, root).groupBy("parallel_id").pivot("language", langs).agg(F.first("code")), "parallel_id", "left")


def cached(spark: SparkSession, cache: str, splits: list[str], refresh: bool = False) -> DataFrame:
    """SRC5: the cached table; if there is none, or it is to be made again, all splits are joined and written there."""
    if refresh or not found(spark, cache):
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(s) for s in splits])
        whole.write.mode("overwrite").option("compression", "zstd").parquet(cache)
    return spark.read.parquet(cache)


def projected(table: DataFrame, key: str, columns: list[str], name: str = "parallel_id") -> DataFrame:
    """SRC6: the columns of a secondary source under the base's name of the key."""
    return table.select(F.col(key).alias(name), *columns)


def generations(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: ordinal and text of a positional JSON list of lists."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("ordinal", "x")).select("ordinal", F.try_element_at("x", F.lit(1)).alias("generation"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC9: a JSON array of records, with the columns that are asked for."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: no file means no exclusions."""
    schema = "parallel_id long, target_language string, outcome string"
    return records(spark, path, schema) if found(spark, path) else spark.createDataFrame([], schema)


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC11: path and text of each JSON document, whole, for text.nested to look into."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: name and value of each line 'name=value'; blank lines and comments are skipped, others an error."""
    t = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'")
    p = F.split("value", "=", 2)
    return t.select(F.when(F.size(p) == 2, F.trim(p[0])).otherwise(F.raise_error(F.concat(F.lit("no '=' in: "), "value"))).alias("name"), F.trim(F.try_element_at(p, F.lit(2))).alias("source"))


def texts(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """SRC13: one column of some Parquet tables."""
    parts = []
    for p in paths:
        df = spark.read.parquet(p)
        if column not in df.columns:
            raise ValueError(f"{p} has no column {column}; it has {', '.join(df.columns)}")
        parts.append(df.select(column))
    return reduce(DataFrame.unionByName, parts)


#: Suffix of a benchmark's name: the language, and how it is written.
BENCHMARKS = {"cpp": ("cpp", "C++"), "java": ("java", "Java"), "rs": ("rust", "Rust"), "go": ("go", "Go"), "py": ("python", "Python"), "python": ("python", "Python")}


def benchmark_rows(rows: DataFrame, config: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """SRC14: name, language, display, prompt and tests of a benchmark's rows. Python rows (task_id, prompt, test,
    entry_point) get a call of their check; others (name, prompt, tests) have tests that run by themselves."""
    suffix = config.rpartition("-")[2]
    if suffix not in BENCHMARKS:
        raise ValueError(f"no language for {config!r}: its name must end in one of {', '.join(sorted(BENCHMARKS))}")
    lang, display = BENCHMARKS[suffix]
    if limit is not None:
        rows = (rows.orderBy(order) if order else rows).limit(limit)
    name, tests = (F.col("name"), F.col("tests")) if lang != "python" else (F.col("task_id"), F.concat("test", F.lit("\n\ncheck("), "entry_point", F.lit(")\n")))
    return rows.select(name.alias("name"), F.lit(lang).alias("language"), F.lit(display).alias("display"), "prompt", tests.alias("tests"))


def completion_request(display: Column, prompt: Column) -> Column:
    """F8: what a model is asked for a benchmark's function."""
    return F.concat(F.lit("Write the rest of this "), display, F.lit(" function and answer with one fenced block that has all of it.\n\n"), prompt)
