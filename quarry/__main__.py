import sys

from .cli import run

run(sys.argv[1:])
