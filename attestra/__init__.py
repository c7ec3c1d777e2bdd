"""Attestra: document-verification and corpus operators written as Spark jobs."""
