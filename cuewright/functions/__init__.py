"""Part of the subtitle-corpus library."""
