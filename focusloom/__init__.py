"""Privacy-gated activity analytics on PySpark.

Every operator is a function of DataFrames; time-dependent ones take ``as_of``.
"""
