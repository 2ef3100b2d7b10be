"""Training-data operators: de-duplication, filtering, extraction, packing and scoring of text corpora.

Nothing else in the library imports this subpackage. ``queries`` lists one query per operator.
"""
