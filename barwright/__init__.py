"""Market-window analytics on Spark: bars, windows, features, labels, scans and models as DataFrame functions."""
