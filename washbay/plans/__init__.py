"""washbay.plans."""
