"""The driver contract when a package that only the training-data operators need is missing."""

import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def test_the_rest_works_where_a_package_is_missing():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as E; "
        "assert 'broken_docks' in E.queries() and 'broken_docks' in E.oracle_sql(); "
        "assert not [k for k in E.queries() if k.startswith('op') or k == 'pipeline'], sorted(E.queries())"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0, done.stderr
