"""News pages rendered from the ``documents`` table, and what must come out.

The test tables hold no page of either site, so every document is written out as
a listing item and as an article page.  The expected results are computed from
the document's columns, never by parsing.
"""
