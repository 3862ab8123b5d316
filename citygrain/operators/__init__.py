"""Dataflow operators: DataFrame in, lazy DataFrame out."""
