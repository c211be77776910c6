"""washbay.functions."""
