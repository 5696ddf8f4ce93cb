"""Text forms of corners, points, frame lists and path parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import point


def clean_path_part(name: Column) -> Column:
    """Letters, digits, '_', '.' and '-' stay, others become '_'; outer signs
    go; nothing left is 'run'."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("run"))


def parse_points(text: Column) -> Column:
    """'x,y:x,y' as points; null where any part isn't two numbers."""
    parts = F.transform(F.split(text, ":"), lambda s: F.split(s, ","))
    points = F.transform(parts, lambda p: point(F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double")))
    good = F.forall(parts, lambda p: F.size(p) == 2) & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(good, points)


def parse_corners(text: Column) -> Column:
    """parse_points() with exactly four, else null."""
    points = parse_points(text)
    return F.when(F.size(points) == 4, points)


def parse_frames(text: Column) -> Column:
    """'a,b,c' as frame numbers, blanks skipped; null if one isn't a number or is
    negative."""
    parts = F.filter(F.split(text, ","), lambda s: F.trim(s) != "")
    numbers = F.transform(parts, lambda s: F.trim(s).try_cast("bigint"))
    return F.when(F.forall(numbers, lambda n: F.coalesce(n >= 0, F.lit(False))), numbers)


def format_points(points: Column) -> Column:
    """Half to even, as 'x,y:x,y'."""
    whole = lambda v: F.bround(v).cast("long").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", whole(p["x"]), whole(p["y"]))), ":")
