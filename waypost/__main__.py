import sys

from waypost.shell import main

sys.exit(main())
