"""Training-data pipeline operators on Spark DataFrames.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
