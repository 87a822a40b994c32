"""``python -m tidemark FILE FOLDER [--runs N] [--seed S] [--master M]``: build a baseline from a file of runs."""

from __future__ import annotations

import argparse

from .plans.pipelines import process_file
from .session import session


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("file")
    parser.add_argument("folder")
    parser.add_argument("--runs", type=int)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--master")
    args = parser.parse_args()
    process_file(session(args.master), args.file, args.folder, args.runs, args.seed)


if __name__ == "__main__":
    main()
