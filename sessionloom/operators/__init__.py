"""Session, candidate, feature, ranking and metric operators: DataFrame in, DataFrame out."""
