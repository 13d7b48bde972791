from pyspark.sql import functions as F

from codelake.functions import text
from codelake.operators.graph import degrees, reachable
from codelake.sources import lines


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_calls(spark):
    call = lambda s: one(spark, s, text.call_of)
    assert call("  SPAWN (a, f(b, c), {d, e}) // x") == ("SPAWN", ["a", "f(b, c)", "{d, e}"])
    assert call("RESET()") == ("RESET", [])
    assert call("OBJ(/* m */ a, b)") == ("OBJ", ["a", "b"])
    for s in ("};", "// f(x)", "", "{", "3f(x)"):
        assert call(s) is None


def test_macro_args_need_the_whole_name(spark):
    assert one(spark, "OBJECT(a, b)", lambda c: text.macro_args(c, "OBJECT")) == ["a", "b"]
    assert one(spark, "OBJECT_WITH_ACTS(a, b)", lambda c: text.macro_args(c, "OBJECT")) is None
    assert one(spark, "END()", lambda c: text.macro_args(c, "END")) == [""]


def test_split_and_acts(spark):
    assert one(spark, "a,[b,c],{d,(e,f)}", text.split_top_level) == ["a", "[b,c]", "{d,(e,f)}"]
    assert one(spark, "a)b,c", text.split_top_level) == ["a)b", "c"]
    assert one(spark, "ALL_ACTS", text.acts) == [True] * 6
    assert one(spark, "ACT_1 | ACT_3", text.acts) == [True, False, True, False, False, False]
    assert one(spark, "*/ x /* y */", text.without_block_comments) == "*/ x "


def test_strings_hold_what_looks_like_comments_and_commas(spark):
    cut = lambda s: one(spark, s, text.without_comments)
    assert cut('f("http://x", 2); // y') == 'f("http://x", 2);' and cut('g("/* no */") /* yes */ ;') == 'g("/* no */")  ;'
    assert cut(r"""h('"', "a\"// b") // c""") == r"""h('"', "a\"// b")""" and cut("it's // don't") == "it's" and cut("//") == "" and cut("a / b * c") == "a / b * c"
    assert one(spark, 'x // a /* b\ny /* c */ z', text.without_block_comments) == "x // a /* b\ny  z"
    split = lambda s: one(spark, s, text.split_top_level)
    assert split('"a,b",c,\',\',d') == ['"a,b"', "c", "','", "d"] and split('f("),("),2') == ['f("),(")', "2"]
    assert split("") == [""] and split(",") == ["", ""] and split("a,") == ["a", ""] and split("a,,b") == ["a", "", "b"]
    assert split("a(b,c") == ["a(b,c"] and split("x,[a,(b],c)") == ["x", "[a,(b],c)"] and split("a\",b") == ['a"', "b"]
    deep = "(" * 15 + "a,b" + ")" * 15
    assert split(f"x,{deep},y") == ["x", deep, "y"]
    assert one(spark, 'say("one, (two", f(3)) // x', text.call_of) == ("say", ['"one, (two"', "f(3)"])


def test_a_line_of_a_megabyte_is_split_in_no_time(spark):
    import time

    line = ",".join(f"{{{i},(a,b),\"x,y\"}}" for i in range(55_000))
    df = spark.createDataFrame([(line,), ("(" * 300_000,), ('"' * 300_001,), (f"f({line})",)], "x string")
    began = time.time()
    found = df.select(F.size(text.split_top_level(F.col("x"))), F.length(text.without_comments(F.col("x"))), text.call_of(F.col("x"))["name"]).collect()
    assert len(line) > 10**6 and [r[0] for r in found] == [55_000, 1, 1, 1] and found[0][1] == len(line) and found[3][2] == "f" and time.time() - began < 20


def test_reachable_ends_on_cycles_and_keeps_leaves(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (5,)], "root int")
    assert sorted(map(tuple, reachable(edges, roots).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5)]
    leaves = spark.createDataFrame([(2,)], "node int")
    assert sorted(map(tuple, reachable(edges, roots, leaves).collect())) == [(1, 1), (1, 2), (5, 5)]
    assert dict(map(tuple, degrees(edges).collect())) == {1: 2, 2: 2, 3: 3, 4: 1, 5: 1}


def test_lines_keep_their_numbers(spark, tmp_path):
    place = tmp_path / "levels" / "cove" / "areas" / "2"
    place.mkdir(parents=True)
    (place / "a.inc.c").write_text("#ifdef X\nA(1)\n#endif\nB(2)")
    rows = lines.with_level_and_area(lines.lines(lines.files(spark, str(tmp_path), "*.c", strip_conditionals=True))).orderBy("line").collect()
    assert [(r["line"], r["text"], r["level"], r["area"]) for r in rows] == [(1, "", "cove", 2), (2, "A(1)", "cove", 2), (3, "", "cove", 2), (4, "B(2)", "cove", 2)]


def test_not_in_goes_by_sqls_rules_for_nulls(spark):
    from codelake.operators.state import not_in

    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    kept = lambda *values: sorted((r["a"] for r in not_in(rows, "a", spark.createDataFrame([(v,) for v in values], "v int")).collect()), key=str)
    assert kept(2, 3) == [1] and kept(2, None) == [] and kept() == [1, 2, None]
