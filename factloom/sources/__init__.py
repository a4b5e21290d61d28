"""Scans and sinks: raw pages, HTML text, robots rules, signed blobs, tables."""
