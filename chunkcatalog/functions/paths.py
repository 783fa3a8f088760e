"""Path expressions; all are columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """Without leading slashes; inner and closing ones stay."""
    return F.regexp_replace(path, "^/+", "")


def parent(path: Column) -> Column:
    p = clean(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def name(path: Column) -> Column:
    return F.regexp_replace(clean(path), "^.*/", "")


def bucket(path: Column) -> Column:
    """First component; '' for files at the root."""
    p = clean(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """Directories above a path, deepest first, without the root."""
    parts = F.split(clean(path), "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def join(directory: Column, child: Column) -> Column:
    return F.concat_ws("/", F.nullif(directory, F.lit("")), child)


def base(path: Column) -> Column:
    """Last component; '/' for the root."""
    return F.when(clean(path) == "", "/").otherwise(F.substring_index(F.regexp_replace(clean(path), "/+$", ""), "/", -1))


def inside(path: Column, root: str | Column) -> Column:
    """Is ``path`` the directory ``root`` or below it? Case matters, and no character is a wildcard."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def moved(path: Column, old: str, new: str) -> Column:
    """``path`` with its leading ``old`` replaced by ``new``, where it lies inside ``old``."""
    return F.when(inside(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
