"""Operators: DataFrame to DataFrame, keyed by `qid` where there are queries, ranked by explicit columns."""
