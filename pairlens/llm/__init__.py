"""Operators for preparing large text corpora, one module each.

Nothing outside this subpackage imports it.  Worker functions are pickled by
value, so executors need the third-party libraries but not this package.
"""
