"""Ranked retrieval, case similarity and corpus analytics as DataFrame operators."""
