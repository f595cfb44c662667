"""Training-data operators for very large corpora.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; :mod:`tracemill.llm.queries` derives the digest queries from them.
"""
