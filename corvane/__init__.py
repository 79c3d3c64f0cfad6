"""corvane: a Spark-native engine for code and text intelligence.

Relational work is declared with DataFrames so that Catalyst picks the physical
plan; Python workers are used only for parsing and specialised string metrics.
"""
