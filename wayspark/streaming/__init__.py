"""Raw trips as a stream: cleaned, encoded and counted as they arrive."""
