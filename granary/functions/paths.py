"""Column functions over virtual paths, names in archives and shell patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that desktop shells ask for in every folder, and first segments that they probe. Fixed values.
SHELL_NAMES = ["desktop.ini", "autorun.inf", "thumbs.db", "folder.jpg", "folder.gif", "icon.ico"]
SHELL_ROOTS = ["$recycle.bin", "system volume information"]
UNSUPPORTED_SUFFIX = " (NOT SUPPORTED)"
LABEL_LENGTH = 32


def normalize(path: Column) -> Column:
    """A virtual path: forward slashes, none doubled, none at the ends; blank and null paths are the root, ''."""
    slashed = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when(F.trim(slashed) == "", "").otherwise(F.regexp_replace(slashed, "^/|/$", ""))


def entry_name(name: Column) -> Column:
    """A name stored in an archive: forward slashes, one leading slash dropped, nothing collapsed."""
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/", "")


def relative(path: Column, root: Column) -> Column:
    """path below root, with forward slashes."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def directory_of(path: Column) -> Column:
    """The path of what holds path; '' at the top."""
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "(^|/)[^/]*$", "")


def fold(path: Column, ignore_case: bool = True) -> Column:
    """What two paths are compared by. Upper case, character for character: one that would become several stays as it is."""
    if not ignore_case:
        return path
    each = F.array_join(F.transform(F.split(path, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return F.when(F.length(F.upper(path)) == F.length(path), F.upper(path)).otherwise(each)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def prefixes(path: Column, whole: bool = True) -> Column:
    """Every prefix of path that ends at a segment, shortest first, path itself only if whole."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if whole else 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def format_of(path: Column, formats: dict[str, str] | None = None) -> Column:
    """Format by extension, in any case; null if none supports it. Content is not looked at."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    out = F.lit(None).cast("string")
    for e, f in (formats or {".zip": "zip", ".rar": "rar"}).items():
        out = F.when(ext == e, F.lit(f)).otherwise(out)
    return out


def shell_metadata(path: Column) -> Column:
    """Whether a backslash path is one that shells probe and no archive holds."""
    last = F.lower(F.element_at(F.split(path, r"\\"), -1))
    first = F.lower(F.element_at(F.split(F.regexp_replace(path, r"^\\+", ""), r"\\"), 1))
    return last.isin(SHELL_NAMES) | first.isin(SHELL_ROOTS)


def matches(name: Column, pattern: str) -> Column:
    """Wildcard match of a whole name in any case: * any run, ? one character; *.* and the empty pattern match all."""
    if pattern in ("", "*", "*.*"):
        return name.isNotNull()
    quoted = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.+^$()[]{}|" else c for c in pattern)
    return name.rlike(f"(?is)^{quoted}$")


def volume_label(name: Column) -> Column:
    return F.substring(name, 1, LABEL_LENGTH)


def unsupported_name(path: Column) -> Column:
    return F.concat(path, F.lit(UNSUPPORTED_SUFFIX))
