"""python tools/names.py FAMILY...: the queries of these families."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
print(*(n for f in sys.argv[1:] for n in importlib.import_module(f"corpusloom.plans.{f}").QUERIES))
