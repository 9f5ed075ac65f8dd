"""Spark-native document analytics: declarative DataFrame operators over page text.

Operators are functions from DataFrames (or Columns) to DataFrames (or
Columns); nothing in this package runs a row loop on the driver.
"""

__version__ = "0.1.0"
