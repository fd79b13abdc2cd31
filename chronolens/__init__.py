"""Time-calibrated evidence analytics for scored-item tables, written as Spark DataFrame operators."""
