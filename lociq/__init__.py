"""lociq: Spark-native analytics over scored intervals, gene blocks and record tables."""
