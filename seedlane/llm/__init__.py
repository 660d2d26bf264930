"""Operators for preparing training data from documents, vectors and pages."""
