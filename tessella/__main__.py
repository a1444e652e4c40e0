"""python -m tessella"""

import sys

from tessella.cli import main

sys.exit(main())
