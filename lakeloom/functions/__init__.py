"""Scalar functions: Columns where SQL says them, Arrow-batched pandas UDFs where it can't."""
