"""Training-data operators over the ``documents``, ``pages`` and ``benchmark`` tables.

Nothing outside this folder imports it.
"""
