"""Parents of packages within their repository."""

from pkgloom.operators import joins


def test_root_prefixes_and_names(spark):
    rows = [("r", "root", ""), ("r", "a", "a"), ("r", "deep", "a/b/c"), ("r", "beside", "ab"), ("lone", "only", "x"), ("n", "tool", "tool"), ("n", "other", "lib/other"), ("o", "own", "acme"), ("o", "kid", "kid"), ("none", "p", "p"), ("none", "q", "q")]
    paths = spark.createDataFrame(rows, "repo string, package string, path string")
    repos = spark.createDataFrame([("r", "a", "b"), ("n", "rust-tool", "x"), ("o", "y", "acme-rs"), ("lone", "x", "x"), ("none", None, "z")], "repo string, repo_name string, owner_name string")
    got = {x.package: x.parent for x in joins.nearest_ancestor(paths, repos).collect()}
    # the root package itself falls back to the package at the repository's name
    assert got == {"root": "a", "a": "root", "deep": "a", "beside": "root", "only": None, "tool": None, "other": "tool", "own": None, "kid": "own", "p": None, "q": None}
    assert {x.package: x.parent for x in joins.nearest_ancestor(paths).collect()} == {**got, "root": None, "other": None, "kid": None}
    assert joins.nearest_ancestor(paths.limit(0), repos).count() == 0
