"""Table and stream operators for ordered event and trade data, on PySpark."""
