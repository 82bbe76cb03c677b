"""Readers and writers: dumps, delimited files, JSON lists, vector tables, reports."""
