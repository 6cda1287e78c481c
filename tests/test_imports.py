"""Every module can be the first one imported."""

import os
import pkgutil
import subprocess
import sys

import pytest

import alphaloom

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

MODULES = [m.name for m in pkgutil.walk_packages(alphaloom.__path__, "alphaloom.") if ".llm" not in m.name]


@pytest.mark.parametrize("chunk", range(4))
def test_each_module_first(chunk):
    code = "import importlib, sys\nfor name in sys.argv[1:]:\n    for k in [k for k in sys.modules if k.startswith('alphaloom')]:\n        del sys.modules[k]\n    importlib.import_module(name)\n    from alphaloom.queries import QUERIES\n    assert 'b02_long_short' in QUERIES, name"
    done = subprocess.run([sys.executable, "-c", code, *MODULES[chunk::4]], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
