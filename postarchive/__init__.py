"""Spark-native archive of saved social posts.

The public entry points are :class:`postarchive.plans.archive.Archive` (read
queries), :mod:`postarchive.plans.ingest` (import and sync jobs) and
:class:`postarchive.streaming.ingest.StreamIngest` (continuous ingest).
"""
