"""Readers and writers of logs, tables, manifests and journals."""
