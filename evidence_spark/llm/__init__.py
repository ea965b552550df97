"""Operators for preparing training text at corpus scale."""

import os

# Small linear algebra runs beside Spark's own threads; more of them only get in the way.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
