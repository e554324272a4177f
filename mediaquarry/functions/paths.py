"""Path, file-name and naming rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def dotted_suffix(name: Column) -> Column:
    """Text after the last dot, lower-cased; ``.jpg`` has the suffix ``jpg``."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_extension(name: Column) -> Column:
    """Extension for sorting: a leading or a trailing dot separates nothing."""
    tail = F.substring_index(name, ".", -1)
    separates = (F.length(tail) > 0) & (F.length(name) > F.length(tail) + 1)
    return F.when(separates & name.contains("."), F.lower(tail)).otherwise("")


def kind_from_extension(name: Column) -> Column:
    suffix = dotted_suffix(name)
    return (
        F.when(suffix.isin(fv.IMAGE_EXTENSIONS), "image")
        .when(suffix.isin(fv.VIDEO_EXTENSIONS), "video")
        .otherwise("unknown")
    )


def clean_path(path: Column, fold_case: bool = False) -> Column:
    """Collapse ``//``, ``.`` and ``..``. Paths without them skip the fold."""
    absolute = path.startswith("/")
    none = F.array().cast("array<string>")

    def push(stack: Column, part: Column) -> Column:
        top = F.get(stack, F.size(stack) - 1)
        return (
            F.when(part != "..", F.concat(stack, F.array(part)))
            .when((F.size(stack) > 0) & (top != ".."), F.slice(stack, 1, F.size(stack) - 1))
            .when(absolute, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(F.aggregate(parts, none, push), "/")
    folded = F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
    untidy = path.rlike(r"(^|/)\.{1,2}(/|$)|//|./$")
    cleaned = F.when(untidy, folded).otherwise(path)
    return F.lower(cleaned) if fold_case else cleaned


def within_root(path: Column, root: Column, fold_case: bool = False) -> Column:
    p, r = clean_path(path, fold_case), clean_path(root, fold_case)
    prefix = F.when(r.endswith("/"), r).otherwise(F.concat(r, F.lit("/")))
    return (p == r) | F.startswith(p, prefix)


def path_order(path: Column) -> Column:
    """Sort key equal to walking directories in name order."""
    return F.split(path, "/")


def managed_path(media_id: Column, digest: Column, file_name: Column) -> Column:
    key = F.sha2(media_id, 256)
    suffix = dotted_suffix(file_name)
    return F.concat(
        F.lit("originals/"), F.substring(key, 1, 2), F.lit("/"), key, F.lit("/"),
        F.sha2(digest, 256), F.when(suffix != "", F.concat(F.lit("."), suffix)).otherwise(""),
    )


def _already_clean(path: Column) -> Column:
    return clean_path(path) == path


def safe_managed_path(path: Column) -> Column:
    return F.coalesce(path.startswith("originals/") & _already_clean(path), F.lit(False))


def original_path(storage: Column, source_path: Column, managed: Column) -> Column:
    """Where the bytes are; NULL when a managed path is unsafe."""
    return F.when(storage == "referenced", source_path).when(safe_managed_path(managed), managed)


def safe_archive_path(path: Column) -> Column:
    return F.coalesce(path.startswith("store/") & _already_clean(path), F.lit(False))


def record_file_name(media_id: Column) -> Column:
    safe = media_id.rlike(r"\A[a-z0-9._-]{1,64}\z") & ~media_id.startswith(".")
    encoded = F.concat(F.lit("x-"), F.lower(F.hex(F.encode(media_id, "UTF-8"))))
    return F.concat(F.when(safe, media_id).otherwise(encoded), F.lit(".json"))


def shard_for(file_name: Column) -> Column:
    return F.rpad(F.substring(file_name, 1, 2), 2, "_")


def supports_embedded_write(path: Column) -> Column:
    return dotted_suffix(base_name(path)).isin(fv.EMBEDDED_WRITE_EXTENSIONS)


def indexable(path: Column, signature: Column) -> Column:
    """A known media extension or a container the extraction job can read."""
    return (kind_from_extension(base_name(path)) != "unknown") | (signature != "unknown")


def sidecar_candidates(path: Column) -> tuple[Column, Column]:
    """``(appended, replaced)`` sidecar paths; the first one present wins."""
    name = base_name(path)
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(path, F.lit(".xmp")), F.concat(folder, stem, F.lit(".xmp"))
