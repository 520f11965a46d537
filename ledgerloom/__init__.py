"""Marketplace order analytics as lazy PySpark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame. Importing the package
does no work, and nothing here runs a Spark job except the sinks, the batch
jobs in ``ledgerloom.plans`` and the few functions that say so.
"""
