"""Part of folioloom."""
