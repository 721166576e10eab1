import glob
import importlib.util
import os

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        pytest.skip("no tokenizer files here")
    with open(os.path.join(os.path.dirname(spec.origin), "byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="session")
def small():
    return sorted(glob.glob("/root/testdata/sf0.001"))[0]
