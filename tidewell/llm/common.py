"""What the corpus operators share: words, row keys, and tables written to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, scoped  # noqa: F401

#: White space that ends a word, as Python's bytes.split() has it: space, and tab to carriage return.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a document's row. Rows with equal doc_id and text share it; rows that repeat a doc_id with another text don't."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)
