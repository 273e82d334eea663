import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) or longer rows."""
    def make(*rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1])) for r in full], DOC)
    return make
