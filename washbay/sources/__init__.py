"""washbay.sources."""
