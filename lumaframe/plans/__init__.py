"""Named frames, and sessions and shared programs as JSON plans."""
