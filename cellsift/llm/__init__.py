"""Operators of a training-data pipeline; nothing else in the package imports them.

Row identity: operators never need ``doc_id`` to be unique or non-null. Each
takes only the columns that it names, so further columns may have any name.
"""
