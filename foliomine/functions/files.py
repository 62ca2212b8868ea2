"""Identity of a file: name, extension, checksum, type, id."""

import re

from pyspark.sql import Column, functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name start none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(checksum: Column, path: Column) -> Column:
    """Stable id of one content at one path."""
    return F.md5(F.concat(checksum, F.lit("|"), path))


def _starts_with(content: Column, signature: str) -> Column:
    size = len(signature) // 2
    return F.substring(content, 1, size) == F.to_binary(F.lit(signature), F.lit("hex"))


def mime_type(content: Column) -> Column:
    """Type told from the leading bytes of a binary column."""
    text = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(F.length(content) == 0, "inode/x-empty")
        .when(_starts_with(content, "25504446"), "application/pdf")
        .when(_starts_with(content, "FFD8FF"), "image/jpeg")
        .when(_starts_with(content, "89504E47"), "image/png")
        .when(
            _starts_with(content, "49492A00") | _starts_with(content, "4D4D002A"),
            "image/tiff",
        )
        .when(text.rlike(r"(?i)\A\s*<(?:!doctype html|html)"), "text/html")
        .when(text.isNotNull(), "text/plain")
        .otherwise("application/octet-stream")
    )


def glob_to_regex(glob: str) -> str:
    """A shell glob as a Java regex over a run of whole path parts."""
    wild = {"*": ".*", "?": "."}
    body = "".join(wild.get(c) or re.escape(c) for c in glob)
    return rf"(?s)(?:\A|/){body}(?:\z|/)"
