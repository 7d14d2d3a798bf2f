"""SQL dump files as DataFrames: header by name, rows by pattern, columns picked and cast.

A dump holds CREATE TABLE with one column a line, then INSERT statements whose rows stand
one or more to a line. Lines are read by Spark's text reader (gzip and bzip2 as well); a
filter on one raw value runs before anything is decoded.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = r"(?:NULL|'(?:[^'\\]|\\.)*'|[^',()]+)"
KEPT = "\ufdd0"  # stands for an escaped backslash while others are undone; not a character of any text
# Escapes of strings in dumps.
ESCAPES = {r"\0": "\0", r"\n": "\n", r"\r": "\r", r"\t": "\t", r"\Z": "\x1a"}


def header(spark: SparkSession, path: str, lines: int = 2000) -> tuple[list[str], int | None]:
    """(column names, AUTO_INCREMENT or None) from the file's beginning."""
    names: list[str] = []
    inside = False
    for row in spark.read.text(path).limit(lines).toLocalIterator():
        if re.match(r"\s*CREATE TABLE\b", row.value, re.I):
            inside = True
        elif inside and (m := re.match(r"\s*`([^`]+)`\s", row.value)):
            names.append(m[1])
        elif inside and row.value.lstrip().startswith(")"):
            m = re.search(r"AUTO_INCREMENT=(\d+)", row.value)
            return names, int(m[1]) if m else None
    if not names:
        raise ValueError(f"{path}: no CREATE TABLE within {lines} lines")
    return names, None


def unquoted(value: Column) -> Column:
    """A raw value as text: NULL to null, quotes off, escapes undone; a number as it is."""
    inner = F.replace(F.regexp_extract(value, r"(?s)^'(.*)'$", 1), F.lit("\\\\"), F.lit(KEPT))
    for escape, char in ESCAPES.items():
        inner = F.replace(inner, F.lit(escape), F.lit(char))
    inner = F.replace(F.regexp_replace(inner, r"(?s)\\(.)", "$1"), F.lit(KEPT), F.lit("\\"))
    return F.when(value == "NULL", F.lit(None)).when(value.startswith("'"), inner).otherwise(value)


def rows(spark: SparkSession, path: str, columns: list[str], where: tuple[str, str] | None = None, casts: dict[str, str] | None = None) -> DataFrame:
    """The named columns of every row, as text or cast (null where a value can't be).

    ``where``: (column, raw value) compared before decoding. A data line in which no row can be
    read fails the job, since a row lost in silence is worse.
    """
    names, _ = header(spark, path)
    missing = [c for c in [*columns, *([where[0]] if where else [])] if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}; there are {', '.join(names)}")
    tuple_ = r"\(" + ",".join([VALUE] * len(names)) + r"\)(?=\s*[,;]|\s*$)"
    picked = {c: "^" + r"\(" + ",".join(f"({VALUE})" if n == c else VALUE for n in names) + r"\)$" for c in names}
    line = F.regexp_replace("value", r"^INSERT INTO .*? VALUES\s*", "")
    data = spark.read.text(path).select(line.alias("line")).where(F.col("line").startswith("("))
    found = F.regexp_extract_all("line", F.lit(f"({tuple_})"), 1)
    checked = F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.concat(F.lit("a dump line can't be read: "), F.substring("line", 1, 80))).cast("array<string>"))
    each = data.select(F.explode(checked).alias("row"))
    if where:
        each = each.where(F.regexp_extract("row", picked[where[0]], 1) == where[1])
    out = each.select(*[unquoted(F.regexp_extract("row", picked[c], 1)).alias(c) for c in columns])
    for c, kind in (casts or {}).items():
        out = out.withColumn(c, F.col(c).try_cast(kind))
    return out


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, ns, title, is_redirect, length) of the page table's main namespace."""
    raw = rows(spark, path, ["page_id", "page_namespace", "page_title", "page_is_redirect", "page_len"], where=("page_namespace", "0"), casts={"page_id": "long", "page_namespace": "int", "page_is_redirect": "int", "page_len": "long"})
    return raw.select("page_id", F.col("page_namespace").alias("ns"), F.translate("page_title", "_", " ").alias("title"), (F.col("page_is_redirect") == 1).alias("is_redirect"), F.col("page_len").alias("length"))


def redirects(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, ["rd_from", "rd_namespace", "rd_title", "rd_interwiki"], where=("rd_namespace", "0"), casts={"rd_from": "long", "rd_namespace": "int"})
    return raw.withColumn("rd_title", F.translate("rd_title", "_", " "))


def linktargets(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, ["lt_id", "lt_namespace", "lt_title"], where=("lt_namespace", "0"), casts={"lt_id": "long", "lt_namespace": "int"})
    return raw.withColumn("lt_title", F.translate("lt_title", "_", " "))


def pagelinks(spark: SparkSession, path: str) -> DataFrame:
    columns = ["pl_from", "pl_from_namespace", "pl_target_id"]
    return rows(spark, path, columns, casts=dict.fromkeys(columns, "long"))


def geo_tags(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate tags; coordinates stay text, since a value that isn't a number is a counted rejection."""
    columns = ["gt_id", "gt_page_id", "gt_globe", "gt_primary", "gt_lat", "gt_lon", "gt_type"]
    return rows(spark, path, columns, casts={"gt_id": "long", "gt_page_id": "long", "gt_primary": "int"})


def langlinks(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark, path, ["ll_from", "ll_lang"], casts={"ll_from": "long"})


def verify(spark: SparkSession, folder: str, names: list[str], sums: str = "sha1sums.txt") -> None:
    """Compares each file's SHA-1 with the list; ValueError for a missing or different one.

    Files are hashed as streams by the JVM, a few at a time, so a file's size doesn't matter.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    known = {r.value.split()[-1].lstrip("*"): r.value.split()[0] for r in spark.read.text(f"{folder}/{sums}").collect() if r.value.strip()}

    def digest(name: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        stream = path.getFileSystem(conf).open(path)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha1Hex(stream)
        finally:
            stream.close()

    for name in names:
        if name not in known:
            raise ValueError(f"{name} isn't in {sums}")
    with ThreadPoolExecutor(4) as pool:
        for name, got in zip(names, pool.map(digest, names), strict=True):
            if got != known[name]:
                raise ValueError(f"{name} is damaged: its checksum is {got}, not {known[name]}")
