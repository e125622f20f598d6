"""Training-data operators: thirteen distributed corpus operators and their queries.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
