"""Operators for building training data from documents and web pages.

Nothing outside this subpackage imports it; deleting it leaves the rest of the engine whole.
"""
