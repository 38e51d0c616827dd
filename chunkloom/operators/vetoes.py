"""Predicates that keep files out of a scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extension, file_name

#: A veto: (path, length in bytes) -> condition under which the file stays out.
Veto = Callable[[Column, Column], Column]

# The largest file taken, the folders and the suffixes that stay out.
MAX_LENGTH = 1_000_000
BUILD_FOLDERS = ("target", "build")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")


def in_build_folder(path: Column, length: Column) -> Column:
    return reduce(Column.__or__, (path.contains(x) for x in BUILD_FOLDERS))


def too_long(most: int = MAX_LENGTH) -> Veto:
    return lambda path, length: length > most


def hidden(path: Column, length: Column) -> Column:
    return file_name(path).startswith(".")


def image(path: Column, length: Column) -> Column:
    return reduce(Column.__or__, (path.endswith(x) for x in IMAGE_SUFFIXES))


def not_listed(white_list: str | None, compat: bool = False) -> Veto:
    """Endings outside a comma-separated list; no list, no veto. ``compat`` asks only that the list contains the ending."""
    if not (white_list or "").strip():
        return lambda path, length: F.lit(False)
    if compat:
        return lambda path, length: ~F.lit(white_list).contains(extension(path))
    endings = [x.strip().lstrip(".") for x in white_list.split(",") if x.strip()]
    return lambda path, length: ~extension(path).isin(endings)


def standard_vetoes(white_list: str | None = None, most: int = MAX_LENGTH, enabled: bool = True) -> list[Veto]:
    own: list[Veto] = [in_build_folder, too_long(most), hidden, image] if enabled else []
    return [*own, not_listed(white_list)] if enabled else own


def vetoed(vetoes: Iterable[Veto], path: str = "path", length: str = "length") -> Column:
    """True where any veto holds; one that is null does not."""
    return reduce(Column.__or__, (F.coalesce(v(F.col(path), F.col(length)), F.lit(False)) for v in vetoes), F.lit(False))


def allowed(files: DataFrame, vetoes: Iterable[Veto], path: str = "path", length: str = "length") -> DataFrame:
    return files.filter(~vetoed(vetoes, path, length))


def unprocessed(files: DataFrame, done: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Each path once, without those in ``done``."""
    files = files.dropDuplicates([path])
    return files if done is None else files.join(done.select(path).distinct(), path, "left_anti")
