"""A versioned analytics engine on Spark: relational operators, snapshots, and log decoding."""
