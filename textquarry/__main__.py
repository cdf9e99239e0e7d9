import sys

from textquarry.cli import main

sys.exit(main())
