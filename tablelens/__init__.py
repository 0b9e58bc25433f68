"""tablelens — exploratory statistics on Spark DataFrames.

Every operator takes a DataFrame (plus column names) and returns a lazy
DataFrame: validation, cleaning, whole-table profile, single-column and pair
tests, target analysis, the numbers behind common charts, and findings as rows.
"""

__version__ = "0.1.0"
