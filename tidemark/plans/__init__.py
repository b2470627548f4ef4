"""Layout of files in levels: versions, overlaps, compaction, collection."""
