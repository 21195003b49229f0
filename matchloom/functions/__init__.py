"""Part of matchloom."""
