"""Operations of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`tesserae.llm.queries` derives the
registered queries from them.
"""
