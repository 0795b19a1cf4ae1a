"""Charts as plain data, from frames whose rows Spark has aggregated."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..errors import BrindleError, ColumnError
from ..operators.histogram import histogram as count_bins

#: Points that a chart takes from a frame at most; larger frames should be aggregated or sampled first.
MOST_POINTS = 100_000
#: Default colours, dimensions and margins.
COLORS = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")
WIDTH, HEIGHT = 600, 400
PADDING = {"top": 40, "right": 20, "bottom": 50, "left": 60}


@dataclass
class Series:
    name: str
    points: list[tuple]
    color: str = COLORS[0]
    style: dict = field(default_factory=dict)


@dataclass
class Chart:
    kind: str
    series: list[Series]
    x_label: str = ""
    y_label: str = ""
    title: str | None = None
    width: int = WIDTH
    height: int = HEIGHT
    padding: dict = field(default_factory=lambda: dict(PADDING))
    options: dict = field(default_factory=dict)

    def to_json(self) -> dict:
        return asdict(self)

    def to_svg(self) -> str:
        from .svg import render

        return render(self)

    def to_vega_lite(self) -> dict:
        from .vega import vega_lite

        return vega_lite(self)

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_svg())


class Plot:
    """plot(df).bar(x, y), .line(x, y), .scatter(x, y), .histogram(column)."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    def _points(self, x: str, y: str, numeric_x: bool) -> list[tuple]:
        for c in (x, y):
            if c not in self._df.columns:
                raise ColumnError(f"no column {c!r}; there are {self._df.columns}")
        value = F.col(x).cast("double") if numeric_x else F.col(x)
        rows = self._df.select(value.alias("x"), F.col(y).cast("double").alias("y")).filter("y is not null").limit(MOST_POINTS + 1).collect()
        if len(rows) > MOST_POINTS:
            raise BrindleError(f"over {MOST_POINTS} points: aggregate or sample first")
        return [(r["x"] if isinstance(r["x"], (int, float)) else str(r["x"]), r["y"]) for r in rows if r["x"] is not None]

    def _chart(self, kind: str, x: str, y: str, numeric_x: bool, title, width, height, padding, color, style, **options) -> Chart:
        series = Series("default", self._points(x, y, numeric_x), color or COLORS[0], style)
        return Chart(kind, [series], x, y, title, width, height, PADDING | (padding or {}), options)

    def bar(self, x: str, y: str, title=None, width=WIDTH, height=HEIGHT, padding=None, color=None, horizontal: bool = False) -> Chart:
        return self._chart("bar", x, y, False, title, width, height, padding, color, {}, horizontal=horizontal)

    def line(self, x: str, y: str, title=None, width=WIDTH, height=HEIGHT, padding=None, color=None, stroke_width: float = 2, show_points: bool = False) -> Chart:
        return self._chart("line", x, y, False, title, width, height, padding, color, {"stroke_width": stroke_width, "point_radius": 3 if show_points else 0})

    def scatter(self, x: str, y: str, title=None, width=WIDTH, height=HEIGHT, padding=None, color=None, point_radius: float = 4, opacity: float = 0.7) -> Chart:
        return self._chart("scatter", x, y, True, title, width, height, padding, color, {"point_radius": point_radius, "opacity": opacity})

    def histogram(self, column: str, bins: int = 10, title=None, width=WIDTH, height=HEIGHT, padding=None, color=None) -> Chart:
        """Left edges with counts; the last point is the right edge with 0. Counted in Spark."""
        rows = sorted(count_bins(self._df, column, bins).collect())
        points = [(r["low"], r["count"]) for r in rows] + [(r["high"], 0) for r in rows[-1:]]
        return Chart("histogram", [Series("default", points, color or COLORS[0])], column, "Frequency", title, width, height, PADDING | (padding or {}))


def plot(df: DataFrame) -> Plot:
    return Plot(df)
