"""Scalar column functions: identities, names, buckets, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_id(path: Column) -> Column:
    """Url-safe base64 of a relative path with ``/`` separators, without padding."""
    plain = F.base64(F.encode(F.translate(path, "\\", "/"), "UTF-8"))
    return F.translate(F.rtrim(F.regexp_replace(plain, "[=\r\n]", "")), "+/", "-_")


def image_path(identity: Column) -> Column:
    """The path an :func:`image_id` stands for."""
    plain = F.translate(identity, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def short_hash(text: Column) -> Column:
    """Eight hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 8)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integers; 999 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def hamming_hex(a: Column, b: Column) -> Column:
    """The same of hex strings of up to 15 digits; 999 where one is missing or empty."""
    number = lambda c: F.conv(F.nullif(c, F.lit("")), 16, 10).cast("long")
    return hamming(number(a), number(b))


def sanitize_filename(name: Column, most: int = 120) -> Column:
    """Characters that file systems refuse and blanks become ``_``, runs of it one; trimmed and cut."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f\s]+', "_")
    return F.substring(F.btrim(F.regexp_replace(clean, "_+", "_"), F.lit("_. ")), 1, most)


def rename(template: str, folder: Column, index: Column, original: Column) -> Column:
    """A file name by template: {folder}, {index:04d}, {original_stem}, {original_name}, {ext}.

    A template with another field falls back to ``{folder}_{index:04d}{ext}``.
    """
    import re

    known = {
        "{folder}": folder,
        "{index:04d}": F.format_string("%04d", index),
        "{index}": index.cast("string"),
        "{original_stem}": stem(original),
        "{original_name}": basename(original),
        "{ext}": extension(original),
    }
    parts = re.split(r"(\{[^}]*\})", template)
    if any(p.startswith("{") and p not in known for p in parts):
        parts = ["{folder}", "_", "{index:04d}", "{ext}"]
    return F.concat(*(known.get(p, F.lit(p)) for p in parts if p))


def cluster_id(value: Column) -> Column:
    """An int from text like ``3`` or ``3.0``; -1 where there is none."""
    return F.coalesce(value.try_cast("double").cast("int"), F.lit(-1))


def orientation(width: Column, height: Column) -> Column:
    ratio = width / height
    return F.when((width <= 0) | (height <= 0), "unknown").when(ratio > 2.0, "wide").when(ratio > 1.1, "landscape").when(ratio < 0.9, "portrait").otherwise("square")


def size_bucket(long_side: Column) -> Column:
    return F.when(long_side <= 0, "unknown").when(long_side <= 512, "small").when(long_side <= 1920, "medium").when(long_side <= 4096, "large").otherwise("huge")


def file_size_bucket(megabytes: Column) -> Column:
    return F.when(megabytes < 0.1, "tiny").when(megabytes < 5, "normal").when(megabytes < 50, "large").otherwise("huge")


def tag_score(percentile: Column, direction: Column | str) -> Column:
    """How well a percentile of 0 to 100 fits ``high``, ``low`` or ``mid``; 0 at least."""
    if isinstance(direction, str):
        direction = F.lit(direction)
    high, low, mid = (percentile - 50) / 50, (50 - percentile) / 50, 1 - F.abs(percentile - 50) / 30
    return F.greatest(F.lit(0.0), F.when(direction == "high", high).when(direction == "low", low).when(direction == "mid", mid))


def palette(cluster: Column, colors: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, colors)), (F.abs(cluster) % len(colors) + 1).cast("int"))


def hist_entropy(hist: Column, eps: float = 1e-6) -> Column:
    """Entropy in bits of a histogram whose bins are raised by ``eps``."""
    return F.aggregate(hist, F.lit(0.0), lambda a, x: a - (x + eps) * F.log2(x + eps))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def recipe_hash(name: Column, parameters: Column, checksum: Column) -> Column:
    """Sixteen hex digits of MD5 that tell runs apart."""
    return F.substring(F.md5(F.concat(name, parameters, checksum).cast("binary")), 1, 16)


def relative_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
