"""Operators that prepare text and vectors for training, one module per operator.

Nothing else in the library imports this subpackage. ``queries`` registers one query per
operator; ``words`` and ``arrow`` hold what several of them share.
"""
