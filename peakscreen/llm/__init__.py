"""Operators for preparing language-model training data.

Thirteen operators, one module each, with their registered queries in ``catalog``.
Nothing outside this subpackage imports it.
"""
