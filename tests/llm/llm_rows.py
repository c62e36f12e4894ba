"""Rows of the test tables."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard string, score string, h int, rep string, kept string, bucket int"


def row(doc_id, text, source="a"):
    """A document with further columns whose names the operators use inside."""
    return (doc_id, text, "en", source, len(text or ""), 1, "x", "y", 2, "r", "k", 3)
