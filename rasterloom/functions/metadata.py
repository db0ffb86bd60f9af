"""Functions on raster metadata: sample types, noData strings, band labels, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dtypes of tile buffers by sample type; any other name gives Float32 (fixed values).
DTYPES = {"UInt8": "u1", "Int8": "i1", "UInt16": "u2", "Int16": "i2", "UInt32": "u4", "Int32": "i4", "Float32": "f4", "Float64": "f8"}


def sample_type(sample_format: Column, bits: Column) -> Column:
    """UInt, Int or Float and the bits, from a file's tags; UInt8 without tags; Unknown for other formats."""
    kind = F.when(sample_format == 1, "UInt").when(sample_format == 2, "Int").when(sample_format == 3, "Float").otherwise("Unknown")
    return F.when(sample_format.isNull() | bits.isNull(), "UInt8").otherwise(F.concat(kind, bits.cast("string")))


def nodata_value(text: Column) -> Column:
    """The number in a noData tag; NaN for any case of nan; null if empty or no number."""
    own = F.btrim(F.replace(text, F.lit("\x00"), F.lit("")))
    return F.when(F.lower(own) == "nan", F.lit(float("nan"))).when(own.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), own.try_cast("double"))


def _labelled(piece: Column) -> Column:
    """sample and label of the text behind an item's opening, or null: DESCRIPTION is named first, the sample's number follows."""
    tag = F.substring_index(piece, ">", 1)
    body = F.substring_index(F.substr(piece, F.length(tag) + 2), "<", 1)
    after = F.substr(tag, F.greatest(F.instr(tag, 'name="DESCRIPTION"'), F.lit(1)))
    number = F.substring_index(F.substring_index(after, ' sample="', -1), '"', 1)
    ok = tag.contains('name="DESCRIPTION"') & after.contains(' sample="') & number.rlike("^[0-9]+$") & F.substr(piece, F.length(tag) + F.length(body) + 2).startswith("</Item>")
    return F.when(ok, F.struct(number.cast("int").alias("sample"), body.alias("label")))


def band_labels(xml: Column, bands: Column) -> Column:
    """A label for each band, empty without one; name stands before sample in the item, and the last item of a band counts."""
    items = F.filter(F.transform(F.split(xml, "<Item\\b"), _labelled), lambda x: x.isNotNull())
    label = lambda i: F.coalesce(F.element_at(F.transform(F.filter(items, lambda x: x["sample"] == i), lambda x: x["label"]), -1), F.lit(""))
    safe = lambda i: F.when(F.size(F.filter(items, lambda x: x["sample"] == i)) > 0, label(i)).otherwise("")
    return F.when(bands < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), bands - 1), safe))


def is_tile_service(url: Column) -> Column:
    return url.contains("{x}") & url.contains("{y}") & url.contains("{z}")


def is_cog(url: Column) -> Column:
    return url.contains(".tif") | url.contains(".TIF")


def tile_url(service: Column, x: Column, y: Column, z: Column) -> Column:
    """The first {x}, {y} and {z} of a template, filled in."""
    out = service
    for name, value in (("x", x), ("y", y), ("z", z)):
        mark = F.lit("{" + name + "}")
        at = F.instr(out, "{" + name + "}")
        out = F.when(at > 0, F.concat(F.substring(out, 1, at - 1), value.cast("string"), F.substring(out, at + F.length(mark), F.length(out)))).otherwise(out)
    return out


def valid_urls(value) -> bool:
    """None, a string, or a list of strings."""
    return value is None or isinstance(value, str) or isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)


def same_urls(a, b) -> bool:
    """Element by element; a single URL is no list of one."""
    return type(a) is type(b) and (list(a) == list(b) if isinstance(a, (list, tuple)) else a == b)
