"""Which files are looked at: pure predicates on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.text import file_name, suffix


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*V.DOCUMENT_EXTENSIONS, *V.IMAGE_EXTENSIONS)


def is_ignored_name(name: Column) -> Column:
    return name.startswith(".") | F.lower(name).isin(*V.IGNORED_DIRECTORIES)


def ignored_reason(path: Column) -> Column:
    """`ignored_directory` if a folder on the way is ignored or the file is hidden, else null."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.exists(folders, is_ignored_name) | file_name(path).startswith("."), V.IGNORED_DIRECTORY)


def rejection(reason: Column, path: Column, detail: Column | None = None) -> Column:
    """`reason: path` or `reason: path: detail`."""
    return F.concat(reason, F.lit(": "), path) if detail is None else F.concat(reason, F.lit(": "), path, F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))


def file_warning(path: Column, size: Column, skip_reason: Column) -> Column:
    """Why a file is not read: what the caller said, its place, its kind or its size; null for files to read."""
    return F.coalesce(
        F.nullif(skip_reason, F.lit("")),
        F.when(ignored_reason(path).isNotNull(), rejection(F.lit(V.IGNORED_DIRECTORY), path)),
        F.when(~is_supported(path), rejection(F.lit(V.UNSUPPORTED_FILE), path)),
        F.when(size > V.MAX_FILE_BYTES, F.concat(path, F.lit(": file is larger than 8 MB"))),
    )
