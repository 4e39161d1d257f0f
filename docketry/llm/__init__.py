"""Training-data operators: each module holds one operator; queries.py registers them.

Nothing outside this folder imports it.
"""
