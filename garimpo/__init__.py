"""Corpus analytics on PySpark: cleaning, segmentation, indexing, retrieval and reports.

Every operator takes DataFrames and returns DataFrames.  Nothing here imports the
optional subpackage ``garimpo.llm``.
"""
