"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``chronolane.llm.registry`` lists
its queries and the SQL that checks them.
"""
