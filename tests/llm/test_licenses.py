import re

import pytest

from scriptorium.llm import licenses

LINES = ("Copyright (c) Facebook, Inc. and its affiliates.", "Copyright Foo Bar", "© The Authors", "(c) Foo Contributors", " * Copyright: Foo\n * Copyright (c) 2020 Bar", "(C) Copyright Foo")


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"])
def test_holders_without_a_year(spark, name):
    # wrapped at each "copyright", so that lines of wording begin with it
    text = re.sub(r" (?=copyright)", "\n", licenses.KNOWN[name], flags=re.I)
    rows = spark.createDataFrame([(i, f"{x}\n\n{text}") for i, x in enumerate((*LINES, "BSD 3-Clause License", "(c) You must keep it"))], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(rows).collect()}
    assert got == {i: name for i in range(len(LINES) + 1)} | {len(LINES) + 1: None}
