"""Readers and writers of the formats that scans come in."""
