"""Detection operators: DataFrame or Column in, the same out."""
