"""kilnmark: Spark-native extraction of dates from noisy label text, and its evaluation."""
