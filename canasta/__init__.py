"""Market-price analytics as Spark DataFrame transformations."""

from canasta.settings import PriceSettings, ReviewPolicy

__all__ = ["PriceSettings", "ReviewPolicy"]
