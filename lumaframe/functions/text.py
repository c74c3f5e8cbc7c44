"""Text of numbers, CSV cells, labels and names.

No Spark built-in prints numbers as the formats ask, so the two printers are pandas UDFs; the rest is columns.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def plain(value: float) -> str:
    """The shortest text that reads back as the same double: exponents below 1e-6 and from 1e21 on only."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    mantissa, _, exponent = repr(float(value)).partition("e")
    if 1e-6 <= abs(value) < 1e21:
        text = format(Decimal(repr(float(value))), "f")
        return text.removesuffix(".0")
    return f"{mantissa.removesuffix('.0')}e{int(exponent):+d}"


def seven_digits(value: float) -> str:
    """Plain decimal text with about seven significant digits; ties of the exact binary value go away from zero."""
    if not math.isfinite(value) or value == 0 or abs(value) >= 1e21:
        return plain(value)
    places = min(20, max(0, 6 - math.floor(math.log10(abs(value)))))
    text = format(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f") if places else format(Decimal(value).quantize(Decimal(1), ROUND_HALF_UP), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@F.pandas_udf(StringType())
def format_number(values: pd.Series) -> pd.Series:
    return values.map(seven_digits, na_action="ignore")


@F.pandas_udf(StringType())
def format_exact(values: pd.Series) -> pd.Series:
    return values.map(plain, na_action="ignore")


def csv_cell(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def mode_label(c: Column) -> Column:
    """The text that names a display mode."""
    # The names.
    return F.when(c == "rgb", "RGB").when(c == "rgba", "RGBA (RGB x alpha)").otherwise(F.upper(c))


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+$", "")


def short_name(c: Column, most: int = 240) -> Column:
    return F.substring(c, 1, most)


def file_kind(path: Column) -> Column:
    """exr, hdr or raster, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "exr", "exr").when(ext.isin("hdr", "pic"), "hdr").otherwise("raster")


# Extensions of content types.
EXTENSIONS = {
    "image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/avif": "avif", "image/gif": "gif", "image/bmp": "bmp",
    "image/vnd.radiance": "hdr", "image/x-hdr": "hdr", "image/hdr": "hdr", "image/x-exr": "exr", "image/exr": "exr", "application/x-exr": "exr",
}


def mime_rank(c: Column) -> Column:
    """0 is the best content type to take of several."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("exr|radiance|hdr"), 0).when(t.isin("", "application/octet-stream"), 1).when(t == "image/png", 2).when(t.startswith("image/"), 3).otherwise(4)


def mime_extension(c: Column) -> Column:
    pairs = [x for kv in EXTENSIONS.items() for x in map(F.lit, kv)]
    return F.try_element_at(F.create_map(*pairs), F.lower(c))


def sniffed_extension(content: Column) -> Column:
    """exr or hdr by the first bytes of a binary column."""
    head = F.hex(F.substring(content, 1, 16))
    return F.when(head.startswith("762F3101"), "exr").when(head.startswith(b"#?RADIANCE".hex().upper()) | head.startswith(b"#?RGBE".hex().upper()), "hdr")


def transfer_note(gamma: Column, has_icc: Column) -> Column:
    """What a PNG says of its transfer and is ignored."""
    return F.when(has_icc, "(iCCP ignored)").when(F.abs(gamma - 0.45455) > 0.02, F.concat(F.lit("(gAMA "), F.format_string("%.4f", gamma), F.lit(" ignored)"))).otherwise("")


def save_formats(source_format: str) -> list[str]:
    return {"exr": ["exr"], "hdr": ["hdr", "exr"]}.get(source_format) or (["png", "jpeg", "webp", "hdr", "exr"] if source_format in ("glsl", "values") else ["png", "jpeg", "webp"])


def is_hdr(type_: Column, source_format: Column) -> Column:
    return type_.startswith("openexr/") | type_.startswith("radiance-hdr/") | type_.startswith("glsl/") | (source_format == "values")
