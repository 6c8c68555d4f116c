"""Readers and writers: relational tables, documents, delimited files, warehouse folders."""
