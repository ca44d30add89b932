"""Analytics over code knowledge graphs as DataFrame plans."""

__version__ = "0.1.0"
