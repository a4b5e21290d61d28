"""factloom: text-evidence analytics on Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame. The
training-data operators live in the separate subpackage ``llm``, which
nothing else here imports.
"""
