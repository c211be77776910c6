"""washbay.operators."""
