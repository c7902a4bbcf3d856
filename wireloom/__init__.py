"""Network-flow analytics on Spark: clean, label, weigh, classify, score and extract."""
