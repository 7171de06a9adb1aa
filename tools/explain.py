"""Print the formatted physical plan of registered queries.

    python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from hopline.plans import catalog
    from hopline.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8, 64)
    for name in args or ["pipeline_fish"]:
        print(f"==== {name} ====")
        catalog.queries()[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
