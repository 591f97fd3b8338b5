"""Text and vector matching: positions, places, formats, languages, neighbours."""
