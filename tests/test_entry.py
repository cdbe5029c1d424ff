"""The driver's entry works where what the training-data operators import is missing."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_a_package_of_the_training_data_part():
    code = (
        "import sys; sys.modules['zstandard'] = sys.modules['leafmill.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "q, o = e.queries(), e.oracle_sql()\n"
        "assert len(q) > 150 and set(o) <= set(q) and not any(n.startswith('op1') for n in q), len(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
