"""What a file is, from its first 32 bytes; content beats the extension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .binding import let

PROBE_BYTES = 32


def classify_signature(content: Column) -> Column:
    """``jpeg``, ``png``, ``tiff``, ``heif``, ``isobmff`` or ``unknown``."""
    return let(F.hex(F.substring(content, 1, PROBE_BYTES)), _container_of)


def _container_of(head: Column) -> Column:
    size = F.length(head) / 2
    brands = [brand.encode().hex().upper() for brand in fv.IMAGE_BRANDS]
    # The major brand sits at byte 8, the minor version at 12, compatible brands from 16 on.
    slots = F.array(*[F.lit(at) for at in (8, 16, 20, 24, 28)])
    is_picture = F.exists(
        slots,
        lambda at: (at + 4 <= size) & F.substring(head, at * 2 + 1, F.lit(8)).isin(brands),
    )
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(
            F.substring(head, 9, 8) == "66747970",
            F.when(is_picture, "heif").otherwise("isobmff"),
        )
        .otherwise("unknown")
    )


def kind_from_signature(signature: Column) -> Column:
    return (
        F.when(signature.isin("jpeg", "png", "tiff", "heif"), "image")
        .when(signature == "isobmff", "video")
        .otherwise("unknown")
    )
