"""Structured Streaming jobs: live windows (T2-T4) and stream helpers.
File-arrival ingest (T1) lives in ``tillroll.sources.ingest``."""
