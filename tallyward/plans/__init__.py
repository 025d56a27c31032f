"""The reports of each table, the cross-report metrics and the classifier."""
