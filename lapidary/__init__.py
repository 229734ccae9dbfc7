"""lapidary: a PySpark-native engine for curating and analysing generated text records."""

__version__ = "0.1.0"
