import random

import numpy as np
import pytest

from millrace.llm import handwritten, repair


def code(seed, methods=6):
    rng = random.Random(seed)
    w = lambda: rng.choice("alpha beta gamma delta omega sigma kappa lambda theta zeta".split()) + str(rng.randrange(1000))
    body = "".join(f"    public int {w()}(int {w()}, string {w()})\n    {{\n        var {w()} = this.{w()}.{w()}({w()}, {rng.randrange(999)});\n        if ({w()} > {w()}) return {w()};\n        return {w()}.{w()}();\n    }}\n\n" for _ in range(methods))
    return f"using System;\n\nnamespace N{seed};\n\npublic class C{seed}\n{{\n{body}}}\n"


def verdicts(spark, files):
    df = spark.createDataFrame([(f, t, 1) for f, t in files], "file string, text string, tokens int")
    return {r.file: {k for k in ("generated", "minified", "vendored", "data") if r[k]} for r in handwritten.judged(df).collect()}


def hand(n=200):
    return [(f"src/P{i % 5}/Hand{i}.cs", code(1000 + i)) for i in range(n)]


def tool(k, seed, start=200):
    """Files of three tools: head banner, attribute, foot; the body is like anyone's."""
    body = code(seed)
    banner = f"// This file was produced by Meld 2.{seed % 3} from part{seed}.schema. Changes will be lost.\n"
    return {0: banner + body, 1: body.replace("public class", '[GeneratedCode("Stub", "3.1")]\npublic class'), 2: body + f"// end of output of stub for C{seed}, {seed} members written\n"}[k]


def test_kinds(spark):
    rng = random.Random(5)
    library = code(900, 10)
    quiet = lambda k: f"namespace M{k};\nclass M{k} {{\n" + "".join(f'  void Up{i}() {{ mb.Step("s{k}", t => {{ t.Column("c{i}", {i}).Kind("K").Annotate("Tool:Version", "3.1"); }}); }}\n' for i in range(12)) + "}\n"
    tools = [(f"src/P{i % 4}/T{k}_{i}.cs", tool(k, 200 + 10 * i + k)) for k in range(3) for i in range(8)]
    files = hand() + tools
    files += [(f"src/P{i % 3}/Once{i}.cs", "// Was generated by Meld once; maintained by hand since, edit freely.\n" + code(600 + i)) for i in range(5)]
    files += [(f"src/P{i % 3}/Str{i}.cs", f'class F{i} {{ string Head = "// This file was produced by Meld 2.1 from"; }}\n' + code(620 + i)) for i in range(5)]
    files += [
        ("src/own/Foo.cs", "// Licensed under the MIT License.\n" + code(105)), ("src/own/Bar.cs", "// Authors: the Foo team\n" + code(106)), ("src/P1/G.cs", "// bundles are served here; do not edit the cache keys lightly\n" + code(107)),
        ("src/P1/Generated/H.cs", code(108)), ("src/P3/I.cs", "// Copyright (c) Our Works. All rights reserved. Internal use only.\n" + code(109)), ("vendor/none/V.cs", code(113)),
        ("vendor/lib/x/L.cs", "// MIT licensed, the Lib authors\n" + library), ("src/P1/Shared/L.cs", "/* other head */\n" + library.replace("namespace N900", "namespace P1.Shared")), ("src/P4/Util/L.cs", library.replace("\n", "\r\n")),
        ("src/P2/min.js", "!function(e,t){" + "".join(f"function {chr(97 + i % 26)}{chr(97 + i // 26)}(x,w){{return x?w(x[{i}]):0}}" for i in range(60)) + "}();"),
        ("src/P2/Data.cs", "static class D { static int[] V = { " + ", ".join(str(rng.randrange(10**6)) for _ in range(400)) + " }; }"),
        ("src/P2/Sql.cs", code(110) + 'static class Q { const string Text = "select ' + ", ".join(f"t.column_name_{i}" for i in range(150)) + ' from table_name t"; }\n'),
        ("src/P2/Empty.cs", ""), ("src/P2/Null.cs", None), ("src/P2/Blank.cs", " \n\t"), ("src/P2/Comment.cs", "// nothing here\n"), ("src/P2/One.cs", "class A { int B() { return 1; } }"), (None, code(111)), ("src/P9/Long.cs", code(112, 3000)),
    ]
    files += [(f"src/P{k % 4}/Up{k}.cs", ("// Created automatically by tool; DO NOT EDIT.\n" if k < 8 else "") + quiet(k)) for k in range(12)]
    got = verdicts(spark, files)
    want = {f: set() for f, t in files if t}
    want |= {f: {"generated"} for f, _ in tools} | {f"src/P{k % 4}/Up{k}.cs": {"generated"} for k in range(12)}
    want |= {f: {"vendored"} for f in ("vendor/lib/x/L.cs", "src/P1/Shared/L.cs", "src/P4/Util/L.cs")}
    want |= {"src/P2/min.js": {"minified"}, "src/P2/Data.cs": {"data"}}
    assert got == want


def test_a_declaration_alone_is_no_verdict(spark):
    """The rules of a grammar decide; one file's banner is none."""
    assert verdicts(spark, [*hand(20), ("src/P1/Lone.cs", "// <auto-generated />\n" + code(300))])["src/P1/Lone.cs"] == set()


def test_repositories_and_repeated_names(spark):
    library = code(900, 10)
    rows = [("a/L.cs", library, "one"), ("b/L.cs", library, "one"), *((f, t, "one") for f, t in hand(10))]
    df = spark.createDataFrame(rows, "file string, text string, row string")
    assert not [r for r in handwritten.judged(df, repository="row").collect() if r.vendored]
    assert sorted(r.file for r in handwritten.judged(df).collect() if r.vendored) == ["a/L.cs", "b/L.cs"]
    twice = spark.createDataFrame([("a/L.cs", library), ("a/L.cs", code(3)), (None, library), (None, library)], "file string, text string")
    assert sorted((str(r.file), r.vendored) for r in handwritten.judged(twice).collect()) == [("None", True), ("None", True), ("a/L.cs", False), ("a/L.cs", True)]


def test_empty_table(spark):
    assert verdicts(spark, []) == {}
    assert verdicts(spark, [("a", None), ("b", "")]) == {}


def expand(tokens):
    h = 0
    for t in tokens:
        h = (h * int(repair._BASE) + t) % 2**64
    return int(repair.scrambled(np.array([h], np.uint64))[0])


@pytest.mark.parametrize("together", [False, True])
def test_grammars_stand_for_their_tokens(together):
    rng = random.Random(2)
    seqs = [[rng.randrange(1, 6) for _ in range(rng.randrange(0, 120))] for _ in range(60)] + [[7] * n for n in range(1, 40)] + [[1, 2, 3, 4] * 30, []]
    tokens = np.array([t for s in seqs for t in s], np.uint64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    g = repair.infer(tokens, owner, len(seqs), together=together, finish=True)
    assert g.tokens.tolist() == [len(s) for s in seqs]
    roots = {o: (h, n) for o, h, n, up in zip(g.of.tolist(), g.hash.tolist(), g.size.tolist(), g.above.tolist()) if up < 0}
    assert roots == {o: (expand(s), len(s)) for o, s in enumerate(seqs) if len(s) > 1}  # one symbol for all of a sequence
    assert all(g.size[up] > n and g.of[up] == o for o, n, up in zip(g.of, g.size, g.above) if up >= 0)
    for o, h, n, uses in zip(g.of.tolist(), g.hash.tolist(), g.size.tolist(), g.uses.tolist()):
        places = ((seqs[o], i) for i in range(len(seqs[o]) - n + 1)) if not together or n > 2 else ((s, i) for s in seqs for i in range(len(s) - n + 1))
        if not together or n > 2 or rng.random() < 0.05:
            found = sum(expand(s[i : i + n]) == h for s, i in places)
            assert found >= (uses if not together or n == 2 else 1)
    assert (g.covered <= g.tokens).all()


def test_marked_tokens():
    seqs = [[1, 2, 9, 3] * 5, [1, 2, 3, 4] * 5, [9]]
    g = repair.infer(np.array([t for s in seqs for t in s], np.uint64), np.repeat([0, 1, 2], [20, 20, 1]), 3, together=True, mark=9)
    assert g.marked.tolist() == [20, 0, 0] and g.covered.tolist() == [20, 20, 0]


def test_equal_stretches_get_equal_rules():
    rng = random.Random(4)
    common = [rng.randrange(10**6) for _ in range(400)]
    a, b = [1, 2, 3, *common], [*(rng.randrange(10**6) for _ in range(50)), *common, 9]
    g = repair.infer(np.array(a + b, np.uint64), np.repeat([0, 1], [len(a), len(b)]), 2, finish=True)
    by = [{h: n for o, h, n in zip(g.of, g.hash, g.size) if o == k} for k in (0, 1)]
    assert max(n for h, n in by[0].items() if h in by[1]) > 100
