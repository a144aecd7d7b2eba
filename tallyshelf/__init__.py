"""Cataloguing, de-duplicating and organising large file collections with Spark."""
