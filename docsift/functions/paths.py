"""Path expressions (P1-P3, S5, T3).  All are built-in column expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_parent(p) -> Column:
    """Text before the last '/'; NULL when the path has no '/'; '/a' -> ''."""
    p = _c(p)
    last = F.substring_index(p, "/", -1)
    return F.when(F.instr(p, "/") == 0, F.lit(None).cast("string")).otherwise(
        F.substring(p, F.lit(1), F.length(p) - F.length(last) - 1)
    )


def path_depth(p) -> Column:
    """'' -> 0, otherwise 1 + number of '/'."""
    p = _c(p)
    return F.when(F.length(p) == 0, F.lit(0)).otherwise(
        F.length(p) - F.length(F.regexp_replace(p, "/", "")) + 1
    ).cast("long")


def separator_count(p, sep: str = "/") -> Column:
    p = _c(p)
    return F.length(p) - F.length(F.replace(p, F.lit(sep), F.lit("")))


def hierarchy_tokens(p, sep: str = "/") -> Column:
    """All prefixes of a hierarchy: 'a/b/c' -> ['a', 'a/b', 'a/b/c']; '' -> []."""
    p = _c(p)
    # each prefix is cut from the text itself: no list is split again per level
    toks = F.transform(
        F.sequence(F.lit(1), F.coalesce(separator_count(p, sep), F.lit(0)) + 1),
        lambda i: F.call_function("substring_index", p, F.lit(sep), i),
    )
    return F.when(p.isNull(), F.lit(None)).when(F.length(p) == 0, F.array().cast("array<string>")).otherwise(toks)


def path_ancestors(p) -> Column:
    """Path-hierarchy tokens on '/'."""
    return hierarchy_tokens(p, "/")


def strict_ancestors(p, sep: str = "/") -> Column:
    """Prefixes excluding the value itself: 'a.b.c' -> ['a', 'a.b']."""
    toks = hierarchy_tokens(p, sep)
    return F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))


def split_file_path(rel) -> dict[str, Column]:
    """Relative file path -> directory ('' at top), name without extension,
    extension (text after the last dot of the file name; a name whose only dot
    is its first character has no extension)."""
    rel = _c(rel)
    base = F.substring_index(rel, "/", -1)
    directory = F.when(F.instr(rel, "/") == 0, F.lit("")).otherwise(
        F.substring(rel, F.lit(1), F.length(rel) - F.length(base) - 1)
    )
    after_dot = F.substring_index(base, ".", -1)
    has_ext = (F.instr(base, ".") > 0) & (F.length(base) - F.length(after_dot) > 1)
    extension = F.when(has_ext, after_dot).otherwise(F.lit(""))
    name = F.when(has_ext, F.substring(base, F.lit(1), F.length(base) - F.length(after_dot) - 1)).otherwise(base)
    return {"path": directory, "name": name, "extension": extension}


def full_rel_path(path, name, extension) -> Column:
    """Directory + name + extension back to one relative path."""
    path, name, extension = _c(path), _c(name), _c(extension)
    file = F.when(F.length(extension) > 0, F.concat(name, F.lit("."), extension)).otherwise(name)
    return F.when(F.length(path) == 0, file).otherwise(F.concat(path, F.lit("/"), file))


def under(path, prefix: str) -> Column:
    """equal to prefix or below it ('/' boundary), case-sensitive."""
    path = _c(path)
    return (path == F.lit(prefix)) | path.startswith(prefix + "/")
