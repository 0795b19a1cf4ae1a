"""Vega-Lite specifications of charts."""

from __future__ import annotations

MARKS = {"bar": "bar", "line": "line", "scatter": "point", "histogram": "bar"}


def vega_lite(chart) -> dict:
    several = len(chart.series) > 1
    values = []
    for s in chart.series:
        pairs = s.points
        if chart.kind == "histogram":
            values += [{"x": x, "x2": end, "y": y} for (x, y), (end, _) in zip(pairs, pairs[1:])]
        else:
            values += [{"x": x, "y": y} | ({"series": s.name} if several else {}) for x, y in pairs]
    text = any(isinstance(v["x"], str) for v in values)
    x = {"field": "x", "type": "quantitative" if chart.kind in ("scatter", "histogram") or not text and chart.kind == "line" else "nominal" if chart.kind == "bar" else "ordinal", "title": chart.x_label}
    y = {"field": "y", "type": "quantitative", "title": chart.y_label}
    style = chart.series[0].style if chart.series else {}
    mark = {"type": MARKS[chart.kind]}
    if chart.series and not several:
        mark["color"] = chart.series[0].color
    if chart.kind == "line":
        mark |= {"strokeWidth": style.get("stroke_width", 2)} | ({"point": True} if style.get("point_radius") else {})
    encoding = {"x": x, "y": y}
    if chart.kind == "histogram":
        encoding |= {"x": x | {"bin": {"binned": True}}, "x2": {"field": "x2"}}
    if chart.kind == "scatter":
        mark["filled"] = True
        encoding |= {"opacity": {"value": style.get("opacity", 0.7)}, "size": {"value": round(3.14159 * style.get("point_radius", 4) ** 2, 2)}}
    if chart.kind == "bar" and chart.options.get("horizontal"):
        encoding = {"x": y, "y": x}
    if several:
        encoding["color"] = {"field": "series", "type": "nominal"}
    out = {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "width": chart.width, "height": chart.height, "data": {"values": values}, "mark": mark, "encoding": encoding}
    return out | ({"title": chart.title} if chart.title else {})


def vega_lite_svg(chart) -> str:
    """SVG by way of Vega-Lite needs the optional package vl_convert; the built-in renderer is Chart.to_svg."""
    try:
        import vl_convert
    except ImportError as e:
        raise RuntimeError("vl_convert is not installed; Chart.to_svg needs nothing else") from e
    return vl_convert.vegalite_to_svg(vega_lite(chart))
