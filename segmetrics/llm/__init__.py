"""Training-data operators on Spark DataFrames.

Each module holds one operator; ``registry`` holds the thin queries that apply
them to whole tables. Nothing outside this folder and ``corpus_pipeline.py``
imports it.
"""
