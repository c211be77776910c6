"""washbay: set-based Spark operators for appointment-based service businesses.

Bookings, price catalogues, staff attendance, prepaid wash packs and one-time-code
logs are plain DataFrames; every operator returns a lazy DataFrame (or a dict of
them) so Catalyst can prune, push down and fuse the work.
"""

__version__ = "0.1.0"
