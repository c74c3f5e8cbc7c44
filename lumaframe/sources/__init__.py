"""Files and texts to pixel tables and back."""
