"""Operators for preparing training data: quality rules, duplicates, languages, packing, ...

One module for each operator, `arrays`, `shared` and `repeats` with what they have in common,
`queries` and `oracle` with the queries over the test tables.  Nothing else in the library
imports this package.

Every operator takes the columns it needs by name; other columns may be there, under any
names, and are neither read nor returned (the stages of the pipeline return the columns of
`documents`).
"""
