"""Sequential folds: a row's result depends on the state its predecessors left.

Rows are dealt out by key and sorted within partitions by Spark, then streamed:
a task keeps one state, whatever a series' length. The same step functions serve
the streaming operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[Any, tuple], tuple[Any, Any]]

#: Kinds of results that a step may give.
KINDS = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def fold(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, output: str, kind: str, start: Any = None) -> DataFrame:
    """df with a column `output` of type `kind`: step(state, inputs) gives the
    next state and the row's value; a series begins with `start`. Rows without a
    key are one series. Only the inputs are read in Python, as they are (a null
    as None); the other columns pass by in Arrow's form."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")
    rows = df.repartition(F.col(f"`{key}`")).sortWithinPartitions(key, *order)
    rows = rows.select(own, F.col(f"`{key}`").cast("string").alias("series"))
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = start, object()
        for b in batches:
            values = []
            columns = [b.column("own").field(k).to_pylist() for k in places]
            for k, *row in zip(b.column("series").to_pylist(), *columns, strict=True):
                if k != now:
                    state, now = start, k
                state, value = step(state, tuple(row))
                values.append(value)
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(values, KINDS[kind])], ["own", "made"])

    made = rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, made {kind}")
    return made.select(*[F.col("own").getField(c).alias(c) for c in df.columns], F.col("made").alias(output))


def absent(value) -> bool:
    return value is None or value != value


@dataclass(frozen=True)
class RatioGate:
    """Accept a reliable value within `step` of the last accepted one, as a
    ratio; the first reliable value is accepted. A null or NaN is not reliable.
    Inputs: value, reliable."""

    step: float

    def __call__(self, state, row):
        value, reliable = row
        if not reliable or absent(value):
            return state, False
        if state is None or self.step <= 0:
            return value, True
        ok = state > 0 and 1 - self.step <= value / state <= 1 + self.step
        return (value, True) if ok else (state, False)


def quad_measures(q: tuple) -> tuple[float, ...]:
    """Four edges, then the area, of eight corner coordinates in any order: least
    x + y, least y - x, greatest x + y, greatest y - x; of equals the first."""
    given = [(q[2 * i], q[2 * i + 1]) for i in range(4)]
    total, tilt = (lambda c: c[0] + c[1]), (lambda c: c[1] - c[0])
    p = [min(given, key=total), min(given, key=tilt), max(given, key=total), max(given, key=tilt)]

    def side(a, b):
        return ((p[a][0] - p[b][0]) ** 2 + (p[a][1] - p[b][1]) ** 2) ** 0.5

    cross = sum(p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4))
    return side(1, 0), side(2, 1), side(2, 3), side(3, 0), abs(cross) / 2


@dataclass(frozen=True)
class GeometryGate:
    """The corner trajectory's gate. Inputs: reliable and the eight corner
    coordinates, whose corners are ordered before they are compared. The first row
    comes out true, unless first_true is off, but is compared with only if it was
    reliable. A row with a null or NaN corner is not reliable."""

    scale_step: float = 0.035
    area_step: float = 0.08
    first_true: bool = True

    def __call__(self, state, row):
        reliable, quad = row[0], row[1:]
        seen, last = state or (not self.first_true, None)
        if not reliable or any(map(absent, quad)):
            return (True, last), not seen
        now = quad_measures(quad)
        ok = last is None or self.steps_ok(now, last)
        return (True, now if ok else last), ok or not seen

    def steps_ok(self, now, last) -> bool:
        if min(now[:4]) <= 0 or min(last[:4]) <= 0:
            return False
        pairs = [(a, b, self.scale_step) for a, b in zip(now[:4], last[:4], strict=True)] + [(now[4], last[4], self.area_step)]
        return all(s <= 0 or (b > 0 and 1 - s <= a / b <= 1 + s) for a, b, s in pairs)


@dataclass(frozen=True)
class Ema:
    """previous * weight + value * (1 - weight), then held to `most` a step if
    that is positive. A null value leaves the state and has no result."""

    weight: float
    most: float = 0.0

    def __call__(self, state, row):
        value = row[0]
        if value is None or value != value:
            return state, None
        if state is None:
            return value, value
        target = state * self.weight + value * (1 - self.weight)
        if self.most > 0:
            target = state + max(-self.most, min(self.most, target - state))
        return target, target


@dataclass(frozen=True)
class LineRoll:
    """A roll angle followed frame by frame: no measurement or one that jumps
    more than `jump` is a miss and holds the angle; else it is clipped to
    `limit`, averaged, held to `most` a step and clipped again."""

    limit: float = 1.0
    weight: float = 0.80
    most: float = 0.12
    jump: float = 0.45

    def __call__(self, state, row):
        value = row[0]
        if value is None or value != value:
            return state, state
        if state is not None and self.jump > 0 and abs(value - state) > self.jump:
            return state, state
        target = max(-self.limit, min(self.limit, value))
        if state is not None:
            target = state * self.weight + target * (1 - self.weight)
            if self.most > 0:
                target = state + max(-self.most, min(self.most, target - state))
            target = max(-self.limit, min(self.limit, target))
        return target, target


@dataclass(frozen=True)
class LineRollDriver:
    """LineRoll with its counts: (angle, updates, misses) after each row."""

    roll: LineRoll = LineRoll()

    def __call__(self, state, row):
        angle, updates, misses = state or (None, 0, 0)
        value = row[0]
        missing = value is None or value != value
        miss = missing or (angle is not None and self.roll.jump > 0 and abs(value - angle) > self.roll.jump)
        angle, _ = self.roll(angle, row)
        state = (angle, updates + (not miss), misses + miss)
        return state, [angle, float(state[1]), float(state[2])]


@dataclass(frozen=True)
class Blend:
    """Flow prediction corrected towards a detection. Inputs: predicted,
    detected; a state before either is the fallback."""

    correction: float = 0.08
    weight: float = 0.0
    fallback: float | None = None

    def __call__(self, state, row):
        predicted, detected = (None if v is None or v != v else v for v in row)
        if state is None:
            now = detected if detected is not None else self.fallback
        elif predicted is not None:
            now = predicted if detected is None else predicted * (1 - self.correction) + detected * self.correction
        else:
            now = detected if detected is not None else state
        if state is not None and now is not None and self.weight > 0:
            now = state * self.weight + now * (1 - self.weight)
        return now, now


@dataclass(frozen=True)
class ResidualSmoother:
    """Translation x and y, rotation and scale averaged together and held to
    their own steps, beginning at rest (no translation or rotation, scale one).
    Inputs: the four, each null if there was no estimate: such a row gets no
    correction and keeps the state. With nothing to smooth the raw values come
    back."""

    weight: float = 0.0
    translation_step: float = 0.0
    rotation_step: float = 0.0
    scale_step: float = 0.0

    def __call__(self, state, row):
        state = state or (0.0, 0.0, 0.0, 1.0)
        if any(map(absent, row)):
            return state, None
        steps = (self.translation_step, self.translation_step, self.rotation_step, self.scale_step)
        if self.weight <= 0 and max(steps) <= 0:
            return row, list(row)
        out = []
        for before, value, most in zip(state, row, steps, strict=True):
            target = before * self.weight + value * (1 - self.weight)
            out.append(before + max(-most, min(most, target - before)) if most > 0 else target)
        return tuple(out), out
