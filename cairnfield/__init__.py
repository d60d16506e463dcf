"""Analytics over large collections of trail maps, lines, pixels and tiles, built on PySpark."""

__version__ = "0.1.0"
