"""Operators for preparing training text, each over whole tables of documents, vectors or conversations."""
