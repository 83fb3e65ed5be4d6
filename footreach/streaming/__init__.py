"""Streams of clicks: sessions, and requests answered by micro-batch."""
