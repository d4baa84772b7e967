"""Format and size of images from their first bytes, without decoding; native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides beyond this make an image one that is to be made smaller.
LARGEST_SIDE = 1080
#: Segments of a JPEG file that are looked at before its frame; a file with more has no known size.
SEGMENTS = 256

# How files begin, and the JPEG markers of frames and of what has no length.
PNG = "89504E470D0A1A0A"
JPEG = "FFD8"
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
BARE = (0x01, *range(0xD0, 0xD9))
END, SCAN, FILL = 0xD9, 0xDA, 0xFF


def _number(content: Column, at: Column | int, count: int) -> Column:
    """The bytes from place `at` (from 0) as one number, highest first; null beyond the end."""
    part = F.substring(content, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(count))
    return F.when(F.length(part) == count, F.conv(F.hex(part), 16, 10).cast("int"))


def image_format(content: Column) -> Column:
    """png or jpeg by the first bytes, whatever the file's name says; else null."""
    begins = lambda magic: F.hex(F.substring(content, 1, len(magic) // 2)) == magic
    return F.when(begins(PNG), "png").when(begins(JPEG), "jpeg")


def _jpeg_size(content: Column) -> Column:
    """struct<width,height> of a JPEG file's frame: steps from segment to segment until one says it."""
    kind = "struct<at:int,width:int,height:int>"
    state = lambda at, w=None, h=None: F.struct(at.cast("int").alias("at"), (F.lit(None) if w is None else w).cast("int").alias("width"), (F.lit(None) if h is None else h).cast("int").alias("height"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, length = _number(content, at + 1, 1), _number(content, at + 2, 2)
        none = F.lit(None).cast("int")
        onward = (
            F.when(marker == FILL, state(at + 1))
            .when(marker.isin(*BARE), state(at + 2))
            .when(marker.isin(*FRAMES), state(none, _number(content, at + 7, 2), _number(content, at + 5, 2)))
            .when(marker.isin(END, SCAN) | length.isNull() | (length < 2), state(none))
            .otherwise(state(at + 2 + length))
        )
        return F.when(at.isNull(), s).when(F.coalesce(_number(content, at, 1) == 0xFF, F.lit(False)), onward).otherwise(state(none)).cast(kind)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state(F.lit(2)).cast(kind), step)


def image_size(content: Column) -> Column:
    """struct<width,height> of a PNG or JPEG file; null where the bytes don't say."""
    png = F.struct(_number(content, 16, 4).alias("width"), _number(content, 20, 4).alias("height"))
    form = image_format(content)
    size = F.when(form == "png", png).when(form == "jpeg", F.struct(_jpeg_size(content)["width"].alias("width"), _jpeg_size(content)["height"].alias("height")))
    return F.when(size["width"].isNotNull() & size["height"].isNotNull(), size)


def too_large(content: Column, most: int = LARGEST_SIDE) -> Column:
    """Whether either side is beyond `most`; false where the size isn't known."""
    size = image_size(content)
    return F.coalesce(F.greatest(size["width"], size["height"]) > most, F.lit(False))
