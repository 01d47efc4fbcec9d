"""Scalar helpers: clipping, grades, words in texts, paths and camera metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRONG, MID, WEAK = "Strong", "Mid", "Weak"


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, as part of other words too."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(F.contains(text, F.lit(w)).cast("int"), F.lit(0))
    return out


def grade(score: Column, strong: float = 0.60, mid: float = 0.41) -> Column:
    return F.when(score >= strong, STRONG).when(score >= mid, MID).otherwise(WEAK)


def grade_level(text: Column) -> Column:
    """2, 1 or 0 from a grade's name, else from a number, else 1."""
    number = text.try_cast("double")
    return (
        F.when(F.contains(text, F.lit(STRONG)), 2)
        .when(F.contains(text, F.lit(MID)), 1)
        .when(F.contains(text, F.lit(WEAK)), 0)
        .when(number >= 0.7, 2)
        .when(number >= 0.4, 1)
        .when(number.isNotNull(), 0)
        .otherwise(1)
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def exif_seconds(text: Column) -> Column:
    """Unix seconds of ``yyyy:MM:dd HH:mm:ss``; 0 if it is none."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double"), F.lit(0.0))


def camera_name(make: Column, model: Column) -> Column:
    """Make and model, without the make if the model starts with its first word."""
    make, model = F.coalesce(F.trim(make), F.lit("")), F.coalesce(F.trim(model), F.lit(""))
    first = F.element_at(F.split(make, " "), 1)
    twice = (make != "") & F.startswith(F.upper(model), F.upper(first))
    out = F.when(twice, model).otherwise(F.trim(F.concat_ws(" ", make, model)))
    return F.when(out != "", out)


def degrees(dms: Column, ref: Column, negative: str) -> Column:
    """Decimal degrees of [degrees, minutes, seconds]; negative for the given reference."""
    at = lambda k: F.get(dms, F.lit(k))
    return (at(0) + at(1) / 60 + at(2) / 3600) * F.when(ref == negative, -1).otherwise(1)


def exposure_bias(ev: Column) -> Column:
    return F.when(ev != 0, F.format_string("%+.1f EV", ev))


def shutter(seconds: Column) -> Column:
    """1/n s below a second, else the number."""
    return F.when((seconds > 0) & (seconds < 1), F.concat(F.lit("1/"), F.round(1 / seconds).cast("long").cast("string"), F.lit("s"))).when(seconds >= 1, F.concat(seconds.cast("long").cast("string"), F.lit("s")))


def coded(code: Column, names: dict[int, str]) -> Column:
    """A name for a small code, or null."""
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out


def aspect_ratio(width: Column, height: Column) -> Column:
    """The nearest common ratio; ties go to the one listed first."""
    ratio = F.when(height != 0, width / height).otherwise(1.0)
    # fixed values: the common ratios
    known = [(1 / 1, "1:1"), (4 / 3, "4:3"), (3 / 2, "3:2"), (16 / 9, "16:9"), (2 / 3, "2:3"), (3 / 4, "3:4"), (9 / 16, "9:16")]
    each = [F.struct(F.abs(F.lit(r) - ratio).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (r, name) in enumerate(known)]
    return F.array_min(F.array(*each))["name"]


def star_rating(score: Column) -> Column:
    return clip(F.bround(score * 5), 0.0, 5.0).cast("int")


def numbers_map(json: Column) -> Column:
    """A JSON object's numbers as a map; an empty map for anything else."""
    got = F.from_json(json, "map<string,double>")
    return F.map_filter(F.coalesce(got, F.from_json(F.lit("{}"), "map<string,double>")), lambda k, v: v.isNotNull())
