"""Repository files as a source: scan, changed lists, size filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never scanned, extensions of supported files, the size limit in bytes.
SKIP = ["bin", "obj", "node_modules", "build", "managed_components", ".cache", ".git", "packages", "TestResults"]
SKIP_PATHS = r"(?i)(^|/)wwwroot/lib/|\.min\.js$"
EXTENSIONS = ["cs", "ts", "js", "py", "sql", "rs", "go", "java", "tf", "yml", "yaml", "cfm", "json"]
MAX_BYTES = 512 * 1024
# Languages of extensions.
LANGUAGE = {"cs": "csharp", "ts": "typescript", "js": "javascript", "py": "python", "sql": "sql", "rs": "rust", "go": "go", "java": "java", "tf": "terraform", "yml": "yaml", "yaml": "yaml", "cfm": "coldfusion", "json": "json"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])
    return names[extension(path)]


def wanted(path: Column) -> Column:
    """Supported extension and no skipped folder on the way."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return extension(path).isin(EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*[F.lit(x.lower()) for x in SKIP])) & ~F.replace(path, F.lit("\\"), F.lit("/")).rlike(SKIP_PATHS)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the wanted files below a folder, at most MAX_BYTES each; larger ones are left unread by length."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace("path", "^.*?" + folder.rstrip("/").rpartition("/")[2] + "/", "")
    return raw.where(F.col("length") <= MAX_BYTES).select(rel.alias("path"), F.decode("content", "UTF-8").alias("content")).where(wanted(F.col("path")))


def listed(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing, deleted) of a list of changed paths."""
    asked = names.select("path").distinct()
    return files.join(asked, "path", "left_semi"), asked.join(files.select("path"), "path", "left_anti")


def window(files: DataFrame, path: str, first: int, last: int, around: int = 0, whole_below: int = 200) -> DataFrame:
    """(line, text) of lines first..last (1-based, inclusive), `around` more on both sides; small files whole when `around` is asked."""
    if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or ":" in path:
        raise ValueError("only relative paths inside the repository")
    f = files.where(F.col("path") == path).select(F.split("content", r"\r\n|\n").alias("l"))
    lines = f.select(F.posexplode("l").alias("i", "text"), F.size("l").alias("n")).select((F.col("i") + 1).alias("line"), "text", "n")
    inside = F.col("line").between(first - around, last + around)
    return lines.where(inside | ((F.col("n") <= whole_below) if around else F.lit(False))).select("line", "text")
