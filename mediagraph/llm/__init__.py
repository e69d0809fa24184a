"""Training-data operators over `documents`, `pages` and `embeddings`: thirteen operators, their registered queries and a corpus pipeline.

Nothing else in the library imports this subpackage.
"""
