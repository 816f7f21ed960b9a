"""tokiwa: a PySpark-native text-analytics engine (normalisation, lexical extraction, morphemes, tags, index)."""

__version__ = "0.1.0"
