"""File formats in and out."""
