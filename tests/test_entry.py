"""The entry module without the optional subpackage's libraries."""

import subprocess
import sys

from .conftest import ROOT


def _queries(blocked: str) -> list[str]:
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {blocked!r} or name == {blocked!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Block())
import warnings
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as E
print(len([w for w in said if "left out" in str(w.message)]), *sorted(E.queries()))
"""
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()


def test_a_missing_library_leaves_the_other_queries():
    for blocked in ("zstandard", "xxhash", "public_tokenizers"):
        warned, *names = _queries(blocked)
        assert warned == "1" and "branch_risk_stats" in names and len(names) >= 97 and not any(n.startswith("op1_") for n in names)


def test_a_missing_subpackage_is_no_warning():
    warned, *names = _queries("cohort_risk.llm")
    assert warned == "0" and len(names) >= 97 and "pipeline" not in names
