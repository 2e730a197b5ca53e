"""Spark jobs for a knowledge ledger: retrieval, fact graphs, triage, activity analytics, text and privacy work."""
