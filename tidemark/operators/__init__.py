"""Reads, scans and writes over versioned logs."""
