"""Reading indexed files, and JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".py": "text/x-python", ".c": "text/x-c", ".h": "text/x-c", ".cpp": "text/x-c++", ".go": "text/x-go",
    ".js": "text/javascript", ".mjs": "text/javascript", ".ts": "text/typescript", ".tsx": "text/typescript", ".json": "application/json", ".html": "text/html", ".css": "text/css",
    ".csv": "text/csv", ".xml": "application/xml", ".yaml": "application/yaml", ".yml": "application/yaml", ".toml": "application/toml", ".tf": "text/x-terraform",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".pdf": "application/pdf", ".zip": "application/zip",
}


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(table[P.suffix(path)], F.lit("application/octet-stream"))


def file_envelope(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with status, mime, encoding and body.

    An empty path is a bad request (400), missing content isn't found (404); text
    comes as it is and other bytes in base64.
    """
    status = F.when(F.coalesce(F.col("path"), F.lit("")) == "", 400).when(F.col("content").isNull(), 404).otherwise(200)
    out = files.withColumn("status", status)
    ok, text = F.col("status") == 200, X.is_text(F.col("content"))
    return (
        out.withColumn("mime", F.when(ok, mime_type(F.col("path"))))
        .withColumn("encoding", F.when(ok, F.when(text, "utf-8").otherwise("base64")))
        .withColumn("body", F.when(ok, F.when(text, F.col("content").cast("string")).otherwise(F.regexp_replace(F.base64("content"), r"[\r\n]", ""))))
    )


def as_json(*columns: str) -> Column:
    """A JSON object without the null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
