"""Boxes: area, rescaling, clipping, validity and labels.  Boxes are (top, right, bottom, left)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_SIDE = 2048
PAD = 30
MIN_AREA = 300_000


def area(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    return (right - left) * (bottom - top)


def keeps(area_: Column, least: int | None) -> Column:
    """Inclusive minimum area; none or 0 keeps all."""
    return area_ >= least if least else F.lit(True)


def validity(area_: Column, least: int) -> Column:
    return F.when(area_ >= least, "Valid").otherwise("Below Threshold")


def fit_scale(height: Column, width: Column, side: int = MAX_SIDE) -> Column:
    """Factor that fits an image into ``side`` x ``side``; 1 if it already does."""
    return F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(height, width))


def rescale(value: Column, original: Column, processed: Column) -> Column:
    """A coordinate on the processed image back on the original, truncated towards zero."""
    return F.when(original == processed, value.cast("int")).otherwise((value * (original / processed)).cast("int"))


def padded(top: Column, right: Column, bottom: Column, left: Column, height: Column, width: Column, pad: int = PAD) -> list[Column]:
    """The box grown by ``pad`` and clipped to the image: top, right, bottom, left."""
    return [F.greatest(top - pad, F.lit(0)), F.least(right + pad, width), F.least(bottom + pad, height), F.greatest(left - pad, F.lit(0))]


def area_label(number: Column, area_: Column) -> Column:
    return F.format_string("Face #%d: %d pixels", number.cast("long"), area_.cast("long"))


TAG_GAP = 10  # between a box and a tag below it


def label_top(top: Column, bottom: Column, label_height: int) -> Column:
    """Where a tag of a box begins: right above it, or a little below where it would leave the image."""
    return F.when(top - label_height >= 0, top - label_height).otherwise(bottom + TAG_GAP)
