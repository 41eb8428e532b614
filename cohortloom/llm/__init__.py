"""Training-data operators: one module for each, built on DataFrames.

Every module has a general operator with real outputs; ``queries`` derives from
them the digest columns that the registered ``opN_<name>`` queries return.
"""
