"""The batch job of quillspark.plans.batch: spark-submit analyse.py RESUMES OUT [--job POSTINGS] [--best N] [--as-of DAY]."""

import sys

from quillspark.plans.batch import main

if __name__ == "__main__":
    sys.exit(main())
