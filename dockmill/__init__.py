"""dockmill: a Spark-native engine for case-record analytics."""
