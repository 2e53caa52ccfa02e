"""Streams of documents from files, in five framings."""
