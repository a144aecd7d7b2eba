"""Readers and writers: folders, catalogs, logs, event streams, reports."""
