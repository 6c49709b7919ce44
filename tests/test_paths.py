from __future__ import annotations

import re

import pytest

from plumbline.functions import paths
from plumbline.functions.paths import glob_regex


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("**/*_mock.go", "a_mock.go", True),
        ("**/*_mock.go", "x/y/a_mock.go", True),
        ("**/*_mock.go", "x/y/a.go", False),
        ("**/mocks/**", "mocks/a.go", True),
        ("**/mocks/**", "x/mocks/y/a.go", True),
        ("**/mocks/**", "mocks", True),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("*.go", "x/a.go", False),
        ("a?.go", "ab.go", True),
        ("a?.go", "a/.go", False),
        ("[a-c].go", "b.go", True),
        ("[^a-c].go", "b.go", False),
        ("[a-", "a", False),
        ("a\\*", "a*", True),
        ("**", "", True),
        ("internal/money/*.go", "internal/money/a.go", True),
    ],
)
def test_glob(pattern, path, want):
    rx = glob_regex(pattern).replace(r"\z", r"\Z")
    assert bool(re.search(rx, path)) is want


def test_derivations(spark):
    rows = [("a/b/pricing.Apply", "x/y.go"), ("Top", "main.go"), ("github.com/go-chi/chi/v5", "a/../b/./c.go"), ("m/p.T.M", "../z.go")]
    d = spark.createDataFrame(rows, "id string, file string")
    got = d.select(
        paths.short("id"), paths.dirname("file"), paths.method_owner("id"), paths.module_short("id"), paths.external_name("id"), paths.clean_path("file")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("pricing.Apply", "x", "a/b/pricing", "pricing.Apply", "a/b/pricing.Apply", "x/y.go"),
        ("Top", ".", None, "Top", "Top", "main.go"),
        ("v5", "a/../b/.", "github", "chi", "go-chi/chi", "b/c.go"),
        ("p.T.M", "..", "m/p.T", "p.T.M", "m/p.T.M", "../z.go"),
    ]
