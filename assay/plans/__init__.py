"""Planning helpers: size checks, skew-proof ordered scans, and whole jobs."""
