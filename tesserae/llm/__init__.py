"""Operators for preparing language-model training data.

Every operator is a function over DataFrames with its own parameters; the thin
``opN_<name>`` queries of :mod:`tesserae.llm.queries` apply them with production
parameters to whole tables.  Nothing outside this subpackage imports it.
"""
