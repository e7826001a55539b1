from loomspark.llm import licenses


def test_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "z.py", ""), (4, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (5, "a/b/c/d/y.py", None),
        (6, "a/w.py", "x = 1. This work is licensed under the GNU General Public License, version 3. And on"), (7, None, "q"), (8, "a2/x", "the license of nothing in particular"), (9, "b/COPYING", "Licensed under CC BY-NC 4.0."),
        (9, "b/COPYING", "Licensed under CC BY-NC 4.0."), (10, "b/x", "Licensed under CC BY-NC 4.0 or so."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "key long, path string, text string, header string, license int")
    got = {r.key: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "Apache-2.0", "a/b"), 3: (None, None, None), 4: ("Apache-2.0", "Apache-2.0", None), 5: (None, "Apache-2.0", "a/b"), 6: ("GPL-3.0", "GPL-3.0", None), 7: (None, None, None),
        8: (None, None, None), 9: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 10: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_root_licence_reaches_every_depth(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "p/q/r.py", "x"), (3, "s.py", "y")], "key long, path string, text string")
    assert {r.key: r.license for r in licenses.scan(df).collect()} == {1: "MIT", 2: "MIT", 3: "MIT"}


def test_no_python_in_the_plan(spark):
    plan = licenses.op3_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_without_a_key_or_with_the_same_key_are_judged_each_for_itself(spark):
    rows = [(None, "a/x", "Released under the MIT License."), (None, "b/y", "There is no license of none."), (7, "c/y", "Released under the MIT License."), (7, "d/y", "nothing"), (8, None, None), (9, "e/z", "")]
    got = {(r.key, r.path): r.license for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert got == {(None, "a/x"): "MIT", (None, "b/y"): None, (7, "c/y"): "MIT", (7, "d/y"): None, (8, None): None, (9, "e/z"): None}


def test_licences_come_of_the_nearest_ancestor(spark):
    note = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/LICENSE.txt", note), (3, "a/b/c/d/x.py", "code"), (4, "a/x.py", "code"), (5, "a/b/y.py", "code " * 5000), (6, "ab/c/y.py", "code"), (7, "x.py", "code")]
    got = {r.key: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", None), 3: ("Apache-2.0", "a/b"), 4: ("MIT", ""), 5: ("Apache-2.0", "a/b"), 6: ("MIT", ""), 7: ("MIT", "")}
