"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Every operator takes a DataFrame with
``doc_id`` and ``text`` (plus whatever the operator needs), never looks at
other columns, and defines its result for nulls, empty texts and repeated rows.
"""
