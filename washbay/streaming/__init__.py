"""washbay.streaming."""
