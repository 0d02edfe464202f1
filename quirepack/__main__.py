"""Command line: python -m quirepack."""

import sys

from quirepack.plans.archive import main

sys.exit(main())
