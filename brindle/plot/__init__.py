"""Charts of small results."""

from .spec import Chart, Plot, Series, plot

__all__ = ["Chart", "Plot", "Series", "plot"]
