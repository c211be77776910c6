"""Import every query module so its queries register."""

from washbay.plans import report_queries  # noqa: F401
from washbay.plans import intake_queries  # noqa: F401
from washbay.plans import window_queries  # noqa: F401
from washbay.plans import change_queries  # noqa: F401
from washbay.plans import stream_queries  # noqa: F401
