"""loomquill: a Spark-native analytics library for dated, attributed text corpora."""
