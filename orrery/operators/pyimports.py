"""Python imports as files of a project."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file, specifier) with ``resolved`` and ``kind``: relative-sibling, module, package-init, external or
    unresolved.

    Dots in front go up from the file's folder, the first to the folder itself; above the root nothing is found. A module
    is a file of its name before a package (``__init__.py``); dots alone are the package. Modules of the standard library
    (of the running Python) are external, whatever files there are. One equi-join with ``files`` (path).
    """
    spec = F.col("specifier")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    name = F.regexp_replace(spec, r"^\.+", "")
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    folder = F.slice(F.split("file", "/"), F.lit(1), F.greatest(F.size(F.split("file", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    inside = (dots == 0) | (dots <= F.size(F.split("file", "/")))
    base = F.array_join(F.when(dots > 0, F.concat(folder, parts)).otherwise(parts), "/")
    init = F.when(base == "", "__init__.py").otherwise(F.concat(base, F.lit("/__init__.py")))
    own = F.when(F.size(parts) > 0, F.concat(base, F.lit(".py")))
    known = F.col("_top").isin(sorted(sys.stdlib_module_names))
    rows = imports.withColumn("_id", F.monotonically_increasing_id()).withColumn("_top", F.split(spec, r"\.")[0])
    rows = rows.withColumn("_external", F.coalesce((dots == 0) & known, F.lit(False))).withColumn("_dots", dots)
    rows = rows.withColumn("_tries", F.when(inside & ~F.col("_external") & (spec != ""), F.array_compact(F.array(own, init))))
    each = rows.select("_id", F.posexplode("_tries").alias("_at", "path"))
    first = each.join(files.select("path").distinct(), "path").groupBy("_id").agg(F.min_by("path", "_at").alias("resolved"))
    kind = (
        F.when(F.col("_external"), "external").when(F.col("resolved").isNull(), "unresolved").when(F.col("_dots") > 0, "relative-sibling")
        .when(F.col("resolved").endswith("__init__.py"), "package-init").otherwise("module")
    )
    return rows.join(first, "_id", "left").select(*imports.columns, "resolved", kind.alias("kind"))
