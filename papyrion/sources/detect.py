"""Source types by explicit type, url scheme or file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> source type.
EXTENSIONS = {
    ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel", ".csv": "excel", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image",
    ".webp": "image", ".gif": "image", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text",
}


def extension(path: Column) -> Column:
    """The last extension of a path, with its dot, in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(path), r"\.[^.]+$", 0)


def by_extension(path: Column) -> Column:
    """The source type of an extension, null if it is unknown."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension(path))


def source_type(url: Column | None = None, path: Column | None = None, explicit: Column | None = None) -> Column:
    """The first of: an explicit type other than auto, the url's scheme, the path's extension."""
    none = F.lit(None).cast("string")
    url, path, explicit = (none if x is None else x for x in (url, path, explicit))
    return F.coalesce(
        F.when(explicit != "auto", explicit),
        F.when(url.startswith("gsheet://"), "gsheet").when(url.startswith("gdoc://"), "gdoc").when(url.isNotNull(), "url"),
        by_extension(path),
    )
