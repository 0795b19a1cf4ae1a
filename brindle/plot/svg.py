"""SVG of charts."""

from __future__ import annotations

from html import escape

from .scales import domain_of, linear_scale, nice_ticks, ordinal_scale


def _number(v: float) -> str:
    return f"{v:.6g}"


def _element(name: str, content: str = "", **attributes) -> str:
    shown = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(_number(v) if isinstance(v, float) else str(v))}"' for k, v in attributes.items())
    return f"<{name}{shown}>{content}</{name}>" if content else f"<{name}{shown}/>"


class _Frame:
    """The plotting area of a chart with its scales."""

    def __init__(self, chart) -> None:
        p = chart.padding
        self.left, self.right, self.top, self.bottom = p["left"], chart.width - p["right"], p["top"], chart.height - p["bottom"]
        xs = [x for s in chart.series for x, _ in s.points]
        ys = [float(y) for s in chart.series for _, y in s.points]
        self.flipped = chart.kind == "bar" and chart.options.get("horizontal")
        self.ordinal = chart.kind == "bar" or any(isinstance(x, str) for x in xs)
        along, across = (self.left, self.right), (self.bottom, self.top)
        if self.flipped:
            along, across = across, along
        if self.ordinal:
            self.names = list(dict.fromkeys(map(str, xs)))
            place, self.band = ordinal_scale(self.names, along)
            self.x = lambda v: place(str(v))
            self.x_ticks = [(place(n), n) for n in self.names]
        else:
            domain = domain_of(xs, nice=chart.kind != "histogram")
            self.x, self.band = linear_scale(domain, along), 0.0
            self.x_ticks = [(self.x(t), _number(t)) for t in nice_ticks(*domain) if domain[0] <= t <= domain[1]]
        if chart.kind in ("bar", "histogram"):
            ys = [0.0, *ys]
        domain = domain_of(ys)
        self.y = linear_scale(domain, across)
        self.zero = self.y(min(max(0.0, domain[0]), domain[1]))
        self.y_ticks = [(self.y(t), _number(t)) for t in nice_ticks(*domain)]


def _axes(chart, f: _Frame) -> str:
    below, beside = (f.y_ticks, f.x_ticks) if f.flipped else (f.x_ticks, f.y_ticks)
    out = [_element("line", x1=f.left, y1=f.bottom, x2=f.right, y2=f.bottom, stroke="#333"), _element("line", x1=f.left, y1=f.top, x2=f.left, y2=f.bottom, stroke="#333")]
    out += [_element("text", escape(t), x=float(at), y=f.bottom + 16, text_anchor="middle", font_size=11) for at, t in below]
    out += [_element("text", escape(t), x=f.left - 6, y=float(at) + 4, text_anchor="end", font_size=11) for at, t in beside]
    low, side = (chart.y_label, chart.x_label) if f.flipped else (chart.x_label, chart.y_label)
    if low:
        out.append(_element("text", escape(low), x=(f.left + f.right) / 2, y=chart.height - 10, text_anchor="middle", font_size=12))
    if side:
        at = (f.top + f.bottom) / 2
        out.append(_element("text", escape(side), x=14, y=at, text_anchor="middle", font_size=12, transform=f"rotate(-90 14 {_number(at)})"))
    if chart.title:
        out.append(_element("text", escape(chart.title), x=chart.width / 2, y=22, text_anchor="middle", font_size=16))
    return "".join(out)


def _bars(s, f: _Frame) -> list[str]:
    out, thick = [], f.band * 0.8
    for x, y in s.points:
        a, b = sorted((f.zero, f.y(float(y))))
        box = {"x": a, "y": f.x(x) - thick / 2, "width": b - a, "height": thick} if f.flipped else {"x": f.x(x) - thick / 2, "y": a, "width": thick, "height": b - a}
        out.append(_element("rect", **{k: abs(float(v)) if k in ("width", "height") else float(v) for k, v in box.items()}, fill=s.color))
    return out


def _steps(s, f: _Frame) -> list[str]:
    return [_element("rect", x=float(f.x(x)), y=float(f.y(n)), width=float(f.x(end) - f.x(x)), height=float(f.zero - f.y(n)), fill=s.color, stroke="#fff") for (x, n), (end, _) in zip(s.points, s.points[1:])]


def _dots(s, f: _Frame, radius: float) -> list[str]:
    return [_element("circle", cx=float(f.x(x)), cy=float(f.y(float(y))), r=radius, fill=s.color, opacity=s.style.get("opacity", 1)) for x, y in s.points]


def _line(s, f: _Frame) -> list[str]:
    path = " ".join(f"{'L' if i else 'M'}{_number(f.x(x))},{_number(f.y(float(y)))}" for i, (x, y) in enumerate(s.points))
    out = [_element("path", d=path, fill="none", stroke=s.color, stroke_width=s.style.get("stroke_width", 2))] if path else []
    return out + (_dots(s, f, s.style["point_radius"]) if s.style.get("point_radius") else [])


def render(chart) -> str:
    f = _Frame(chart)
    draw = {"bar": lambda s: _bars(s, f), "histogram": lambda s: _steps(s, f), "line": lambda s: _line(s, f), "scatter": lambda s: _dots(s, f, s.style.get("point_radius", 4))}[chart.kind]
    marks = "".join(m for s in chart.series for m in draw(s))
    body = _element("rect", width=chart.width, height=chart.height, fill="#fff") + _axes(chart, f) + marks
    return _element("svg", body, xmlns="http://www.w3.org/2000/svg", width=chart.width, height=chart.height, viewBox=f"0 0 {chart.width} {chart.height}")
