"""Text listings A2-A5: delimited, whitespace, JSON and free-text forms.

Texts that do not parse are not lost: ``fields_reason``, ``json_reason`` and
``regex_reason`` say what is wrong with a text (null: nothing), and
``quarantine`` splits a listing by that, so that both parts add up to all of it.

A listing is a DataFrame with one text column per line (or one JSON document per
row).  Parsing is built-in expressions only; a multi-line text block is turned
into rows with ``explode(lines(text))``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclaim.functions.paths import _c, base_name
from reclaim.functions.text import lines

ENVS_SCHEMA = T.StructType([T.StructField("envs", T.ArrayType(T.StringType()))])


def read_lines(spark, path: str, out: str = "line") -> DataFrame:
    """A listing stored as text files: one row per line, with the file it came
    from (``spark.read.text`` splits large files across tasks)."""
    return spark.read.text(path).select(F.col("value").alias(out), F.input_file_name().alias("source"))


def read_documents(spark, path: str, out: str = "doc") -> DataFrame:
    """Listings stored one document per file (e.g. JSON output): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias(out),
                                                        F.input_file_name().alias("source"))


def csv_field(line, idx: int, sep: str = ",") -> Column:
    """A2: ``idx``-th (0-based) field of a delimited line (``cut -d, -f idx+1``)."""
    return F.get(F.split(_c(line), re.escape(sep)), idx)


def ws_field(line, idx: int) -> Column:
    """A3: ``idx``-th whitespace-separated field; leading blanks ignored
    (as a whitespace field split or awk ``$n`` does)."""
    return F.get(F.split(F.regexp_replace(_c(line), r"^\s+", ""), r"\s+"), idx)


def explode_lines(df: DataFrame, text: str, out: str = "line") -> DataFrame:
    """One row per line of a text block column (the block column is replaced)."""
    exploded = df.withColumn(out, F.explode(lines(text)))
    return exploded if text == out else exploded.drop(text)


def json_env_names(doc) -> Column:
    """A4: ``{"envs": [path, ...]}`` -> array of the paths' base names."""
    parsed = F.from_json(_c(doc), ENVS_SCHEMA)
    return F.transform(parsed.getField("envs"), lambda p: base_name(p))


def regex_all(line, pattern: str, group: int = 0) -> Column:
    """A5: every match of ``pattern`` in the line (Java regex; look-behind allowed)."""
    return F.regexp_extract_all(_c(line), F.lit(pattern), group)


# Fixed value: the snapshot stamp pattern of a snapshot listing, preceded by a blank.
STAMP_PATTERN = r"(?<=\s)\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"


# ------------------------------------------------------ texts that do not parse
NO_TEXT = "no text"


def _empty(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def fields_reason(line, n: int, sep: str | None = None) -> Column:
    """Why a line is no row of at least ``n`` fields (A2 with ``sep``, else A3)."""
    text = _c(line)
    parts = F.split(text, re.escape(sep)) if sep else F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    few = F.concat(F.size(parts).cast("string"), F.lit(f" of {n} fields"))
    return F.when(_empty(text), F.lit(NO_TEXT)).when(F.size(parts) < n, few)


def json_reason(doc) -> Column:
    """Why a document is no ``{"envs": [...]}`` (A4)."""
    kinds = T.StructType([*ENVS_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(_c(doc), kinds, {"columnNameOfCorruptRecord": "_bad"})
    return (F.when(_empty(_c(doc)), F.lit(NO_TEXT))
            .when(parsed.isNull() | parsed["_bad"].isNotNull(), F.lit("not JSON"))
            .when(parsed["envs"].isNull(), F.lit("no envs")))


def regex_reason(line, pattern: str) -> Column:
    """Why a line has no match (A5)."""
    return F.when(_empty(_c(line)), F.lit(NO_TEXT)).when(~_c(line).rlike(pattern), F.lit("no match"))


def quarantine(listing: DataFrame, text: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``listing`` that parse, and the others with a ``reason`` after
    their columns.  Every row is in one of the two."""
    told = listing.withColumn("reason", reason)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")
