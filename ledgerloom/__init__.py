"""ledgerloom: a PySpark-native engine for quotation, estimating and job-costing data."""
