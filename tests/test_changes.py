"""Changes between listings: trees of digests against plain sets."""

from docketry.operators import changes


def listing(spark, rows):
    return spark.createDataFrame([(p, 1, f) for p, f in rows.items()], "path string, size long, fingerprint string")


def test_changes_are_those_of_the_sets(spark):
    old = {"top.eml": "1", "a/x.eml": "1", "a/b/y.eml": "1", "a/b/z.eml": None, "gone/only.eml": "1", "same/deep/er/q.eml": "1"}
    new = {"top.eml": "2", "a/x.eml": "1", "a/b/y.eml": "1", "a/b/z.eml": "1", "came/n.eml": "1", "same/deep/er/q.eml": "1"}
    for x, y in ((old, new), (new, old), (old, old), ({}, new), (old, {}), ({}, {})):
        a, b = listing(spark, x), listing(spark, y)
        want = {p: "added" if p not in x else "removed" if p not in y else "changed" for p in {*x, *y} if p not in x or p not in y or x[p] != y[p]}
        assert {r.path: r.change for r in changes.changes(a, b).collect()} == want
    # what lies in a folder that is the same is never looked at
    seen = {r.folder: r.differs for r in changes.levels(changes.tree(listing(spark, old)), changes.tree(listing(spark, new))).collect()}
    assert seen == {"": True, "a": True, "a/b": True, "gone": True, "came": True, "same": False}
    total = {r.folder: (r.files, r.bytes) for r in changes.tree(listing(spark, old)).collect()}
    assert total[""] == (6, 6) and total["a"] == (3, 3) and total["same/deep"] == (1, 1)
