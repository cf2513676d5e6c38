"""Hospital infection-surveillance analytics as plain DataFrame functions.

``functions``  Column -> Column helpers for text, numbers, dates and nulls
``sources``    reading, choosing and joining tables; writing results
``operators``  generic DataFrame -> DataFrame building blocks
``plans``      the reports: isolation map, indicators, outbreak history, ...
``catalog``    bindings of the reports to sample tables, with SQL to check them
"""
