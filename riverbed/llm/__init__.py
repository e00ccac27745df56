"""Operators for preparing large text corpora as training data.

Nothing outside this subpackage imports it. On a cluster the package must be importable by the executors' Python
workers (``--py-files`` or an installed wheel).
"""
