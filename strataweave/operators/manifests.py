"""Packages that project files and manifests refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REFERENCE = r"""<PackageReference\s[^>]*Include\s*=\s*"([^"]+)"[^>]*?(?:/>|>[\s\S]*?</PackageReference>)"""


def nuget_references(files: DataFrame) -> DataFrame:
    """files: (project, path, content) of .csproj files. (project, source_qn, target_qn, package, version) of every package reference, with a version as attribute or element, or none."""
    one = F.explode(F.regexp_extract_all("content", F.lit(f"({_REFERENCE})"), F.lit(1))).alias("x")
    name = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)
    r = files.where(F.lower("path").endswith(".csproj")).select("project", name.alias("file"), one)
    version = F.coalesce(F.nullif(F.regexp_extract("x", r'Version\s*=\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.trim(F.regexp_extract("x", r"<Version>([^<]+)</Version>", 1)), F.lit("")))
    r = r.select("project", "file", F.regexp_extract("x", _REFERENCE, 1).alias("package"), version.alias("version"))
    return r.select("project", F.concat("project", F.lit(":project:"), "file").alias("source_qn"), F.concat(F.lit("nuget:"), "package").alias("target_qn"), "package", "version").distinct()


def cargo_references(files: DataFrame) -> DataFrame:
    """files: (project, path, content) of Cargo.toml files outside target folders. (project, crate, package, version) of the dependencies of every kind; the version is null where none is stated."""
    parts = F.split(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/")
    live = files.where((F.element_at(parts, -1) == "cargo.toml") & ~F.array_contains(parts, "target"))
    crate = F.regexp_extract("content", r'(?s)\[package\][^\[]*?\bname\s*=\s*"([^"]+)"', 1)
    sections = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\[[\w.'\"()=, -]*dependencies\]\s*$([\s\S]*?)(?=^\[|\z)"), F.lit(1))).alias("s")
    lines = live.select("project", crate.alias("crate"), sections).select("project", "crate", F.explode(F.split("s", "\n")).alias("x"))
    name = F.regexp_extract("x", r"^\s*([\w-]+)(?:\.workspace)?\s*=", 1)
    version = F.coalesce(F.nullif(F.regexp_extract("x", r'=\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("x", r'version\s*=\s*"([^"]+)"', 1), F.lit("")))
    plain = F.when(F.regexp_like("x", F.lit(r"=\s*\{")), F.nullif(F.regexp_extract("x", r'version\s*=\s*"([^"]+)"', 1), F.lit(""))).otherwise(version)
    return lines.where(name != "").select("project", "crate", name.alias("package"), plain.alias("version")).distinct()
