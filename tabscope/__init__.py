"""Column studies of labelled tables on Spark: quality, profiles, associations,
leakage, splits, models and exact classifier metrics.

Every operator takes DataFrames plus declared column names and returns a lazy,
tidy DataFrame.  Nothing here collects data rows to the driver.
"""
