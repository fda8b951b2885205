"""lowstress: a Spark-native engine for low-stress cycling network analysis."""

__version__ = "0.1.0"
