"""python -m codefacts FILE..., build-contracts STORE ..., or search STORE QUERY."""

import sys

from codefacts.plans.cli import main

sys.exit(main())
