"""Edit recipes as a fold over the frame size; pixels are not touched."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

_PARAMETERS = (
    "x double, y double, width double, height double, degrees double, value double"
)


def recipe_fully_recognized(operations: Column) -> Column:
    return F.forall(operations, lambda o: F.coalesce(o["kind"].isin(fv.OPERATION_KINDS), F.lit(False)))


def oriented_size(width: Column, height: Column, rotation_degrees: Column) -> Column:
    turned = rotation_degrees.isin(90, 270)
    return F.struct(
        F.when(turned, height).otherwise(width).cast("int").alias("w"),
        F.when(turned, width).otherwise(height).cast("int").alias("h"),
    )


def _whole(number: Column) -> Column:
    """A JSON number as int; a fraction reads as 0."""
    return F.when(
        (number == F.floor(number)) & (F.abs(number) < 2147483648.0), number.cast("int")
    ).otherwise(0)


def recipe_outcome(operations: Column, width: Column, height: Column) -> Column:
    """``struct(w, h, error)`` after applying the operations in order; the first failure stops."""
    text = F.lit(None).cast("string")

    def frame(w: Column, h: Column, error: Column) -> Column:
        return F.struct(
            w.cast("int").alias("w"), h.cast("int").alias("h"), error.cast("string").alias("error")
        )

    def step(state: Column, op: Column) -> Column:
        p = F.from_json(op["parameters"], _PARAMETERS)
        x, y, w, h = (_whole(p[k]) for k in ("x", "y", "width", "height"))
        numeric = p["x"].isNotNull() & p["y"].isNotNull() & p["width"].isNotNull() & p["height"].isNotNull()
        inside = (
            (w > 0) & (h > 0) & (x >= 0) & (y >= 0)
            & (x.cast("bigint") + w <= state["w"]) & (y.cast("bigint") + h <= state["h"])
        )
        turns, orientation = _whole(p["degrees"]), _whole(p["value"])
        failed = lambda code: frame(state["w"], state["h"], F.lit(code))
        swapped = frame(state["h"], state["w"], text)
        kept = frame(state["w"], state["h"], text)
        rotate = (
            F.when(p["degrees"].isNull() | (turns % 90 != 0), failed("conflict"))
            .when(turns % 180 != 0, swapped).otherwise(kept)
        )
        orient = (
            F.when(p["value"].isNull() | ~orientation.between(1, 8), failed("conflict"))
            .when(orientation >= 5, swapped).otherwise(kept)
        )
        return (
            F.when(state["error"].isNotNull(), state)
            .when(op["kind"] == "crop", F.when(numeric & inside, frame(w, h, text)).otherwise(failed("conflict")))
            .when(op["kind"] == "rotate", rotate)
            .when(op["kind"] == "orientation", orient)
            .otherwise(failed("unsupportedMedia"))
        )

    start = frame(
        width, height, F.when(~recipe_fully_recognized(operations), "unsupportedMedia")
    )
    return F.aggregate(operations, start, step)


def _scaled(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Keep the aspect ratio, integer arithmetic, at least one pixel a side."""
    w, h = width.cast("bigint"), height.cast("bigint")
    by_height = F.floor(box_h * w / h)
    tall = by_height <= box_w
    new_w = F.when(tall, by_height).otherwise(box_w)
    new_h = F.when(tall, box_h).otherwise(F.floor(box_w * h / w))
    return F.struct(
        F.greatest(new_w, F.lit(1)).cast("int").alias("w"),
        F.greatest(new_h, F.lit(1)).cast("int").alias("h"),
    )


def fit_within(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Shrink into the box; a smaller frame stays as it is."""
    same = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))
    bounded = (box_w > 0) & (box_h > 0)
    larger = (width > box_w) | (height > box_h)
    return F.when(bounded & larger, _scaled(width, height, box_w, box_h)).otherwise(same)


def scale_to_box(width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Thumbnails fill the box as far as the aspect ratio allows, upwards too."""
    return _scaled(width, height, box_w, box_h)
