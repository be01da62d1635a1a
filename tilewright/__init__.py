"""Planning, checking and recording the acquisition of open geospatial data, as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  Facts (catalogue items, files, transfers,
questions, pixels) are never collected; only registry-sized inputs are small by contract, and even those are
joined rather than looked up on the driver.
"""
