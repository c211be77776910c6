"""``python -m washbay <job> ...`` runs the batch jobs of ``washbay.cli``."""

from washbay.cli import main

main()
