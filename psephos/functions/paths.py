"""Path and name functions: natural order, directories, extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions of images.
IMAGE_EXTENSIONS = ("bmp", "png", "jpg", "jpeg", "tif", "tiff")


def natural_key(c: Column, width: int = 18) -> Column:
    """Sort key in which runs of digits compare as numbers: each run is padded with zeros to `width`; longer runs stay as they are."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d") & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p)), "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def parent_name(path: Column) -> Column:
    """The name of the directory a file is in; empty at the top."""
    return file_name(directory(path))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
