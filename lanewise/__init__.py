"""Carrier-network analytics on Spark DataFrames.

Every operator is a lazy function from DataFrames to a DataFrame.  Parameters
are plain arguments whose defaults live in :mod:`lanewise.params`.
"""
