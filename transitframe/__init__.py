"""Route-data analytics for public transport, written as Spark DataFrame operators.

Layout
------
``functions``  column expressions (text, codes, time, geometry, similarity)
``sources``    readers and parsers that turn files and report rows into tables
``operators``  DataFrame -> DataFrame building blocks (lookup, joins, windows, matching, zones)
``plans``      multi-step jobs (publish, synchronise, merge, quality reports) and the query catalogue
"""

__version__ = "0.1.0"
