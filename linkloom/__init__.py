"""linkloom: entity linkage, interest mining and career histories as PySpark DataFrame operators."""

__version__ = "0.1.0"
