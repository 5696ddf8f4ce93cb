"""Window operators over one series in order. All of a plan's windows share one
partitioning and order, so a trajectory of any number of columns is one
exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """Rows of one key in a total order."""

    def __init__(self, key: str | list[str], order: str | list[str]):
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def ordered(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    @property
    def whole(self):
        return Window.partitionBy(*self.key)

    @property
    def all(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def past(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def future(self):
        return self.ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def index(self) -> Column:
        return F.row_number().over(self.ordered) - 1

    def size(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)

    def previous(self, c: Column) -> Column:
        return F.lag(c, 1).over(self.ordered)

    def first(self, c: Column) -> Column:
        return F.first(c).over(self.all)

    def hold(self, c: Column, ok: Column) -> Column:
        """The latest value of an accepted row."""
        return F.last(F.when(ok, c), ignorenulls=True).over(self.past)

    def running_count(self, condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).over(self.past).cast("long")

    def accept_ratio(self, ok: Column) -> Column:
        return F.sum(F.when(ok, 1).otherwise(0)).over(self.whole) / F.greatest(F.lit(1), self.size())

    def interpolate(self, c: Column, ok: Column, index: Column) -> Column:
        """Linear through the accepted rows, held outside them; a series with no
        accepted row keeps its values. Blocked on index: it must be a column."""
        known = F.when(ok, F.struct(index.alias("i"), c.alias("v")))
        low = F.last(known, ignorenulls=True).over(self.past)
        high = F.first(known, ignorenulls=True).over(self.future)
        t = (index - low["i"]) / (high["i"] - low["i"])
        between = F.when(low["i"] == high["i"], low["v"]).otherwise(low["v"] + (high["v"] - low["v"]) * t)
        return F.when(low.isNull() & high.isNull(), c).when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(between)


def centred_filter(df: DataFrame, series: Series, columns: list[str], width: int, kind: str) -> DataFrame:
    """Each column replaced by its median or mean over `width` rows around it;
    beyond an end its last value repeats. A width of one, or fewer than three
    rows, leaves a series as it is."""
    if width <= 1:
        return df
    r = width // 2
    near = series.ordered.rowsBetween(-r, r)
    rn, n = F.row_number().over(series.ordered), series.size()
    names = [f"__{i}" for i in range(len(columns))]
    out = df.withColumns({"__rn": rn, "__n": n})
    out = out.withColumns({"__lp": F.greatest(F.lit(0), r - (F.col("__rn") - 1)).cast("int"), "__rp": F.greatest(F.lit(0), r - (F.col("__n") - F.col("__rn"))).cast("int")})
    made = {}
    for name, c in zip(names, columns, strict=True):
        first, last = F.first(c).over(series.all), F.last(c).over(series.all)
        if kind == "mean":
            value = (F.sum(c).over(near) + F.col("__lp") * first + F.col("__rp") * last) / (2 * r + 1)
        elif kind == "median":
            padded = F.concat(F.array_repeat(first, F.col("__lp")), F.collect_list(c).over(near), F.array_repeat(last, F.col("__rp")))
            value = F.sort_array(padded)[r]
        else:
            raise ValueError(kind)
        made[name] = F.when(F.col("__n") < 3, F.col(c)).otherwise(value)
    out = out.withColumns(made)
    return out.withColumns({c: F.col(n) for c, n in zip(columns, names, strict=True)}).drop("__rn", "__n", "__lp", "__rp", *names)


def smooth_trajectory(df: DataFrame, series: Series, columns: list[str], median: int = 5, mean: int = 31) -> DataFrame:
    """Median, then mean."""
    return centred_filter(centred_filter(df, series, columns, median, "median"), series, columns, mean, "mean")


def smooth_corners(df: DataFrame, series: Series, columns: list[str], median: int = 5, mean: int = 31) -> DataFrame:
    """smooth_trajectory() of the eight corner columns (x and y of TL, TR, BR,
    BL), whose corners are then ordered anew."""
    from ..functions.geometry import order_corners, point

    out = smooth_trajectory(df, series, columns, median, mean)
    quad = order_corners(F.array(*[point(F.col(columns[2 * i]), F.col(columns[2 * i + 1])) for i in range(4)]))
    out = out.withColumn("__quad", quad)
    return out.withColumns({c: F.col("__quad")[k // 2]["x" if k % 2 == 0 else "y"] for k, c in enumerate(columns)}).drop("__quad")


def smooth_residual(df: DataFrame, series: Series, transform: str, median: int, mean: int) -> DataFrame:
    """The transforms of a series taken apart to translation, rotation and mean
    scale, smoothed, and put together as similarities; a missing transform's
    NaN spreads as far as the windows reach."""
    from ..functions.geometry import components, similarity

    names = ["translation_x", "translation_y", "rotation_deg", "scale_avg"]
    parts = df.withColumn("__c", components(F.col(transform)))
    parts = parts.withColumns({f"__{n}": F.col("__c")[n] for n in names}).drop("__c")
    columns = [f"__{n}" for n in names]
    out = smooth_trajectory(parts, series, columns, median, mean)
    return out.withColumn(transform, similarity(*[F.col(c) for c in columns])).drop(*columns)


def adjacent(df: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """Each column's previous value beside it, as previous_<name>; first rows
    have none."""
    return df.withColumns({f"previous_{c}": series.previous(F.col(c)) for c in columns})
