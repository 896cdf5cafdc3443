"""Commerce selection and safe export as PySpark DataFrame operators."""

from tradewind.filters import FilterError, FilterSpec
from tradewind.sources.shop import Shop

__all__ = ["FilterError", "FilterSpec", "Shop"]
