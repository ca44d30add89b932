from datetime import datetime

import numpy as np

from strataweave.llm import authorship as A

CODE = "function load{0}(a, b) {{\n    let total = compute(a, {0});\n    if (total > {0}) {{\n        log.info('late');\n    }}\n    return total;\n}}\n"
MIN = "".join(f"var a{i}=function(b){{return b[{i}]||c}};" for i in range(60))


def test_notices_count_in_comments_only():
    for text in ("// Code generated by protoweave v1. DO NOT EDIT.\nf()", "/*\n * @generated\n */\nf()", "f()\n// AUTOGENERATED FILE - see x.yaml", "// Created by X on 1; manual edits are overwritten\n", "// Automatisch erzeugt mit X 7 - nicht bearbeiten\nf()", "// Released under the MIT licence.\nf()", "// SPDX-License-Identifier: Apache-2.0\nf()", "export const VERSION = 'lib/1.2.3';"):
        assert A.notices("a/b.js", text), text
    for text in ("const H = '// AUTOGENERATED FILE';", "// Do not edit the limits below without asking the team.\nf()", "// The report is generated by the scheduler, see below.\n", "// Parses files that carry an auto-generated marker.\n", "// Generated ids start at one.\n", "const t = `\n// Code generated by x. DO NOT EDIT.\n`;", "// Copyright (c) Harborline Software. All rights reserved.\n// Licensed to customers only.\n", "// Thin wrapper around lib; upgrade notes are in the wiki.\n"):
        assert not A.notices("a/b.js", text), text
    assert A.notices("a.cs", "[System.CodeDom.Compiler.GeneratedCode(\"T\", \"1\")]\nclass A { }") and not A.notices("a.cs", "var a = \"[GeneratedCode(\";")


def test_places_and_shape():
    assert all(map(A.owned_place, ["web/node_modules/x/a.js", "a\\obj\\Debug\\b.cs", "x/a.min.js", "x/a_pb2.py", "x/A.Designer.cs", "x/package-lock.json", "a/libs/external/x.js", "src/generated/a.ts"]))
    assert not any(map(A.owned_place, ["src/Vendors/A.cs", "src/External/a.ts", "src/Packages/a.ts", "config/a.json", "a/objects/x.py", "minutes/a.js", ""]))
    assert A.shape(MIN) and A.shape("T = [\n" + "    1, 2.5, 0x3, 4, 5, 6, 7, 8, 9,\n" * 80 + "]\n")
    assert A.shape("INSERT INTO t (a, b) VALUES\n" + "".join(f"({i}, 'row number {i} of many', {i}.5),\n" for i in range(90)) + "(0, 'end', 0);\n")
    assert not A.shape(CODE.format(3) + 'const QUERY = "' + "a = 1 OR " * 400 + '";') and not A.shape("") and not A.shape("T = [1, 2]\n")


def fitted(rows):
    return A.fit([(p, f, A.example(f, t)) for p, f, t in rows])


def test_classifiers_learn_shape_and_place():
    rows = [(f"p{i % 12}", f"web/src/a{i}.js", "".join(CODE.format(i + k) for k in range(5))) for i in range(90)] + [(f"p{i % 12}", f"web/lib{i}/a{i}.min.js", MIN.replace("a1", f"q{i}")) for i in range(60)]
    m = fitted(rows)
    assert m.report["precision"] >= 0.99 and m.report["recall"] > 0.9
    assert m.scores("web/src/x.js", MIN)[3] >= 0 > m.score("web/src/b.js", CODE.format(9) + CODE.format(8)) and m.of_path("x/y.min.js") >= 0 > m.of_path("x/y.js")
    assert A.fit([]) is None and fitted(rows[:5]) is None
    assert abs(np.linalg.norm(A.text_vector("x" * 400 + "y")) - 1) < 1e-5 and not A.text_vector("").any()


def test_classifiers_find_what_no_rule_names():
    """Copies whose only mark is a notice teach the classifiers; a changed copy in other words is then found by them alone."""
    lib = "// plumeio stream kit {0}\n// {1}\nexport class Plume{0} {{\n    pipe(s) {{ return s.lift({0}).tap(this.sink); }}\n}}\n"
    rows = [(f"p{i % 12}", f"web/src/a{i}.js", "".join(CODE.format(i + k) for k in range(5))) for i in range(90)] + [(f"p{i % 12}", f"web/src/b{i}.js", lib.format(i, "Released under the MIT licence.")) for i in range(60)]
    m = fitted(rows)
    changed = lib.format(77, "free for any use")
    assert not A.confirmed("web/src/c.js", changed)
    assert m.score("web/src/c.js", changed) >= 0 > m.score("web/src/d.js", CODE.format(5))


def test_notice_lines_are_learnt_without_the_owner_s_own():
    """A notice in the owner's name is its own; lines of notices count wherever they stand, and in words near to those of the labels."""
    note = "// Released under the MIT licence.\n"
    own = "// Copyright Harborline Software\n// Released under the MIT licence.\n"
    rows = [(f"p{i % 12}", f"src/a{i}.js", k + "".join(CODE.format(i + j) for j in range(6))) for i in range(120) for k in [("", note, own, "")[i % 4]]]
    m = fitted(rows)
    body = "".join(CODE.format(300 + j) for j in range(40))
    found = lambda t: (lambda s, c: s >= 0 if c is None else c)(*m.verdict("src/z.js", t))
    assert found(body + "// released under the  MIT Licence, v2.\n") and not found(own + body) and not found(body) and not found("")


def test_every_notice_of_the_rules_needs_no_hint():
    for text in ("// DO NOT CHANGE\nclass A {}", "// compiled by protoc, don't edit\nclass A {}"):
        assert A.notices("a.cs", text)


def test_rows(spark):
    d = lambda n: datetime(2024, 1, n)
    rows = [(1, "P", "X", "a/b.js", CODE.format(1), d(1)), (2, "p ", None, "node_modules/a/b.js", CODE.format(2), d(1)), (3, "p", None, "a/c.js", None, d(1)), (4, "p", None, "a/c.js", " \n", d(1)), (5, None, None, None, "x" * 300_000, d(1)), (1, "P", "X", "a/b.js", CODE.format(1), d(1)), (6, "q", None, "a.py", "# @generated\n", None)]
    df = spark.createDataFrame([(*r, "c", 0.0) for r in rows], "file_id long, project string, dotnet_project string, file_path string, content string, scanned_at timestamp, checked string, score double")
    got = {r["file_id"]: (r["project"], r["dotnet_project"], r["foreign"]) for r in A.classify(df).collect()}
    assert got.keys() == {1, 2, 5, 6}
    assert got[1] == ("p", "X", False) and got[2] == ("p", None, True) and got[6][2]
    assert A.classify(df.limit(0)).count() == 0
