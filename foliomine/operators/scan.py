"""Which scanned files are cataloged: ignore rule, index rules, type gate, counters."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from foliomine.functions import files as ff

# The ignore patterns, the declared index rules, the accepted types.
IGNORE_PATTERNS = [
    ".git", "__pycache__", ".pytest_cache", ".DS_Store", "*.pyc", "*.pyo", "*.pyd",
    ".Python", "build", "develop-eggs", "dist", "downloads", "eggs", ".eggs", "lib",
    "lib64", "parts", "sdist", "var", "wheels", "*.egg-info", ".installed.cfg",
    "*.egg", ".env", ".venv", "env", "venv", "ENV", ".idea", ".vscode",
]
INDEX_EXTENSIONS = [".txt", ".pdf", ".doc", ".docx"]
MAX_FILE_SIZE = 100 * 1024 * 1024
INDEX_IGNORE_GLOBS = [".git/*", "*.pyc", "__pycache__/*"]
SUPPORTED_TYPES = ["application/pdf", "image/jpeg", "image/png", "image/tiff"]


def ignored(
    path: Column, patterns: list[str] = IGNORE_PATTERNS, mode: str = "substring"
) -> Column:
    """True for a path to skip. ``substring`` looks for every pattern as plain
    text anywhere in the path (a star is a star); ``glob`` matches path parts."""
    if mode == "glob":
        return path.rlike("|".join(ff.glob_to_regex(p) for p in patterns))
    return reduce(or_, [path.contains(p) for p in patterns])


def count_scan(files: DataFrame, mode: str = "substring") -> DataFrame:
    skip = ignored(F.col("path"), mode=mode)
    return files.agg(
        F.count_if(~skip).alias("processed"), F.count_if(skip).alias("skipped")
    )


def indexable(
    path: Column,
    size: Column,
    extensions: list[str] = INDEX_EXTENSIONS,
    max_size: int = MAX_FILE_SIZE,
    ignore_globs: list[str] = INDEX_IGNORE_GLOBS,
) -> Column:
    """The declared index rules: extension, size, ignore globs."""
    return (
        ff.extension(path).isin(extensions)
        & (size <= max_size)
        & ~ignored(path, ignore_globs, mode="glob")
    )


def type_error(mime_type: Column, supported: list[str] = SUPPORTED_TYPES) -> Column:
    """Error code of a file that cannot be processed, NULL for the others."""
    return F.when(~F.coalesce(mime_type.isin(supported), F.lit(False)), "UNSUPPORTED_FILE_TYPE")
