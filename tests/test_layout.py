"""The engine stands without the training-data subpackage, and operators neither read, write nor collect."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "tripledger"


def test_nothing_outside_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tripledger.llm" not in p.read_text(), p


def test_operators_are_pure():
    for p in (ROOT / "operators").glob("*.py"):
        text = p.read_text()
        if p.name == "mart.py":
            text = text.split("class Store")[0]
        assert not re.search(r"\.collect\(|\.toPandas\(|\.write\b|\.read\b|\.rdd\b|F\.udf|pandas_udf", text), p
