"""Operations of a training-data pipeline: filters, joins, search, packing and token output.

Nothing else in the library imports this subpackage; its queries are in ``queries.py``.
"""
