"""CSV hand-off of a result (e.g. the wide pull) to an offline tool, with a manifest.

The manifest is written last, into a folder that readers of the CSV skip. It
states the schema, the number of rows and a digest of all values. The digest is
taken while the rows are written, so the export is one pass, and it does not depend on
the order of rows or files. ``read_export`` accepts an export only if its
manifest is there and rows and digest agree with the files: a hand-off that was cut off,
lost a file or was edited is an error, not a shorter table.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "rows long, digest string, multiline boolean, schema string"

# The same for writing and reading: every value comes back as it was.
_FORMAT = {
    "header": "true",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


class IncompleteExport(Exception):
    """The export has no manifest, or its files do not hold what the manifest states."""


def _row_hash(columns: list[str]) -> Column:
    """64 bits of a row's values; a NULL differs from every value and from its place in another column."""
    # Hashing skips NULLs, so each value is hashed beside its mark.
    marked = [F.struct(F.col(c).isNull().alias("is_null"), F.col(c).alias("value")) for c in columns]
    return F.xxhash64(*marked)


def _has_line_break(df: DataFrame) -> Column:
    found = F.lit(False)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            found = found | F.coalesce(F.col(field.name).rlike(r"[\r\n]"), F.lit(False))
    return found


def _contents(df: DataFrame) -> list[Column]:
    """Rows, digest and whether a text has a line break, as aggregates over ``df``."""
    row = _row_hash(df.columns)
    # A wide sum keeps repeated rows apart, which an XOR would cancel.
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias("digest"),
        F.coalesce(F.max(_has_line_break(df)), F.lit(False)).alias("multiline"),
    ]


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as a directory of header-bearing CSV part files and a manifest.

    Each task writes its own part; nothing is gathered on the driver. Dates
    are ISO ``yyyy-MM-dd``; NULL is the empty field, an empty text is quoted. ``mode`` is
    ``errorifexists`` or ``overwrite``: a manifest states one whole export.
    """
    if mode not in ("error", "errorifexists", "overwrite"):
        raise ValueError(f"an export is written as a whole, not in mode {mode!r}")
    seen = Observation("export")
    df.observe(seen, *_contents(df)).write.mode(mode).options(**_FORMAT).csv(path)
    found = seen.get
    row = (found["rows"], found["digest"], found["multiline"], df.schema.json())
    df.sparkSession.createDataFrame([row], _MANIFEST_SCHEMA).coalesce(1).write.json(f"{path}/{MANIFEST}")


def export_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the export at ``path``: rows, digest, multiline, schema."""
    try:
        found = spark.read.schema(_MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if len(found) != 1 or found[0]["schema"] is None:
        raise IncompleteExport(f"{path} has no manifest: the export did not end")
    return found[0].asDict()


def read_export(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The exported table with its own types.

    With ``verify`` one more pass compares rows and digest with the manifest; a
    difference raises ``IncompleteExport``. A file is split among tasks unless some text has a line break.
    """
    manifest = export_manifest(spark, path)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    # An empty field is read as the null mark; with Spark's own, the empty text, a quoted empty text would be NULL too.
    options = {**_FORMAT, "multiLine": manifest["multiline"], "enforceSchema": "false", "nullValue": "\0"}
    df = spark.read.schema(schema).options(**options).csv(path)
    if verify:
        rows, digest, _ = df.agg(*_contents(df)).first()
        if (rows, digest) != (manifest["rows"], manifest["digest"]):
            raise IncompleteExport(f"{path} holds {rows} rows (digest {digest}), the manifest says {manifest['rows']} ({manifest['digest']})")
    return df
