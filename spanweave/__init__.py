"""spanweave: analytics on pairwise interval mappings, and on training text, as Spark DataFrame plans."""

__version__ = "0.1.0"
