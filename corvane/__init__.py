"""corvane: a PySpark-native analytics engine for receptor-peptide complex scoring.

``sources`` read files into typed tables, ``functions`` are column expressions, ``operators`` map DataFrames to
DataFrames, ``plans`` join operators into whole jobs, ``streaming`` ingests incrementally.
"""
