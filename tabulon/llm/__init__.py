"""Training-data operators: deduplication, tokenization, filtering and mixing over document tables.

Nothing else in the library imports this package.  Every operator takes a ``DataFrame`` plus column
names; ``queries`` binds them to the driver's ``documents`` table.
"""
