"""Training-data operators: ten corpus jobs and the queries that run them.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is present.
"""
