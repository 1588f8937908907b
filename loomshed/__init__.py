"""loomshed: frame-collection auditing and reconciliation expressed as Spark DataFrames."""
