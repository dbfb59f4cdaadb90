"""Table-level operators: DataFrame in, DataFrame out."""
