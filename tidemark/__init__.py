"""Spark-native analytics over companies, articles and daily time series.

Every operator is a function from DataFrames to a DataFrame. The subpackage
``llm`` (text corpus operators) is optional: nothing else imports it.
"""

__version__ = "0.1.0"
