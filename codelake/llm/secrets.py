"""Operator 9: secrets in texts, by fixed patterns and by a battery of randomness tests.

Everything is built from Spark's own functions. Three fixed patterns give the
base spans. Besides, every run of 20 or more key characters is a candidate, and
where it has `-` or `_` (as URL-safe base64 has) so is the whole run with these:
its encoding (and so its alphabet) is inferred from its characters, and three
tests ask whether it may be uniform noise over that alphabet:

    chi-squared   of the character counts against equal counts
    runs          of characters above and below the alphabet's middle
    serial        correlation of each character with the next

The battery's p-value is three times the least of the three, 1 at most; under
ALPHA the candidate isn't noise and is dropped. That alone would let ordinary
strings of little structure pass, so what is reported is controlled by a second
test whose null is the corpus's own language: a chain of letters, digits and
separators is counted over all words that recur in the texts (`Language`), and a candidate's
p-value is how likely ordinary text is to go so badly with it, by the mean and
the spread that the chain's own words show. Within each bin of lengths (powers of
two), and so with candidates of its own length only, the Benjamini-Hochberg
step-up rule at level FDR decides which candidates aren't ordinary; they are
reported as `random` unless they overlap a base span or lie in a longer one that
is. The rule runs on counts of p-values over a fixed grid, whose size doesn't
depend on the input.

Null and empty texts give no spans (counts 0, the SHA-256 of an empty string,
an empty `spans`). Rows with a null doc_id and repeated rows each give their row;
an empty table gives an empty result. Very long texts and tokens are read whole.
Other columns are ignored. Positions are code points.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, id_and_text, read_table

# Kinds and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/=]{20,}"
WIDE = r"[A-Za-z0-9+/=_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FDR = 0.01
#: Below this the battery says that a candidate isn't noise.
ALPHA = 1e-3
#: Steps of the p-value grid for each power of ten, and its last step.
GRID, LAST = 20, 400
#: What the language's chain goes through: separators, digits (as one) and letters.
STATES = ".0" + LOWER
#: No step counts as rarer than one in so many, so that one odd place doesn't make a string a key.
RAREST = 400
#: Names, abbreviations and the like stray farther than the normal law allows: their spread counts so many times.
STRAY = 2.0
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _places(found: Column, between: Column) -> Column:
    """(start, end) of each match, from the matches and the pieces of text around them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        lo = acc["at"] + F.length(F.get(between, i))
        hi = lo + F.length(F.get(found, i))
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end")))).alias("out"))

    places = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, places).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _of_kind(places: Column, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end")))


# Coefficients of a published Chebyshev fit of the complementary error function (relative error 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to seven digits however small it is."""
    x = F.least(F.abs(z), F.lit(35.0)) / 2**0.5
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = series * t + c
    tail = t * F.exp(series - x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


class Language:
    """The chain of a corpus's words: logarithms of its steps, and what a step adds to a word's sum and to its variance."""

    def __init__(self, logs: list[float], mean: float, spread: float):
        self.logs, self.mean, self.spread = logs, mean, spread

    @staticmethod
    def steps(word: Column) -> Column:
        """Numbers of a word's steps from state to state, from a separator to a separator."""
        parted = F.regexp_replace(word, "(?<=[a-z])(?=[A-Z])", ".")  # words joined by capitals
        letters = F.split(F.concat(F.lit("."), F.translate(F.lower(parted), DIGITS[1:], "0" * 9), F.lit(".")), "")
        # What is no state is a separator.
        at = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.greatest(F.call_function("instr", F.lit(STATES), c), F.lit(1)) - 1)
        return F.transform(F.array(at), lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: x * len(STATES) + y))[0]

    def sum(self, steps: Column) -> Column:
        logs = F.array(*(F.lit(v) for v in self.logs))
        return F.aggregate(steps, F.lit(0.0), lambda total, k: total + F.get(logs, k))

    def p_value(self, word: Column) -> Column:
        """How likely ordinary text of that length is to go as badly with the chain."""
        def measured(steps: Column) -> Column:
            n = F.size(steps)
            return _upper_tail((n * self.mean - self.sum(steps)) / (STRAY * self.spread * F.sqrt(n.cast("double"))))

        return F.transform(F.array(self.steps(word)), measured)[0]


def learn_language(docs: DataFrame) -> Language:
    """From all words that occur twice or more in all texts; only counts of the len(STATES) ** 2 kinds of steps, and two sums, come back."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # Keys stand once, words recur.
    words = cut(words.filter("word <> '' and n > 1").select("n", Language.steps(F.col("word")).alias("steps")))
    n = len(STATES)
    counts = [[1.0] * n for _ in range(n)]
    for row in words.select("n", F.explode("steps").alias("step")).groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[row["step"] // n][row["step"] % n] += row["n"]
    logs = [log(max(c / sum(row), 1 / RAREST)) for row in counts for c in row]
    all_ = sum(map(sum, counts))
    mean = sum(c * v for c, v in zip((c for row in counts for c in row), logs)) / all_
    found = Language(logs, mean, 1.0)
    off = found.sum(F.col("steps")) - F.size("steps") * mean
    sums = words.agg(F.sum(F.col("n") * off * off).alias("squares"), F.sum(F.col("n") * F.size("steps")).alias("steps")).first()
    found.spread = max((sums["squares"] / sums["steps"]) ** 0.5, 0.1) if sums["steps"] else 1.0
    return found


def p_value(token: Column) -> Column:
    """How likely noise over the token's own alphabet is to look as regular as it does."""

    def alphabet(body: Column) -> Column:
        return (
            F.when(body.rlike("^[0-9]+$"), F.lit(DIGITS))
            .when(body.rlike("^[0-9a-f]+$"), F.lit(DIGITS + LOWER[:6]))
            .when(body.rlike("^[0-9A-F]+$"), F.lit(DIGITS + UPPER[:6]))
            .when(body.rlike("^[A-Z2-7]+$"), F.lit(UPPER + DIGITS[2:8]))
            .when(body.rlike("^[0-9a-z]+$"), F.lit(DIGITS + LOWER))
            .when(body.rlike("^[0-9A-Z]+$"), F.lit(DIGITS + UPPER))
            .when(body.rlike("^[0-9A-Za-z]+$"), F.lit(DIGITS + UPPER + LOWER))
            .when(body.rlike("^[0-9A-Za-z+/]+$"), F.lit(DIGITS + UPPER + LOWER + "+/"))
            .when(body.rlike("^[0-9A-Za-z_-]+$"), F.lit(DIGITS + UPPER + LOWER + "-_"))
            .otherwise(F.lit(DIGITS + UPPER + LOWER + "+/-_"))
        )

    def parts(token: Column) -> Column:
        body = F.regexp_replace(token, "=", "")
        return F.struct(body.alias("body"), alphabet(body).alias("letters"))

    def codes(s: Column) -> Column:
        letters = F.filter(F.split(s["body"], ""), lambda c: c != "")
        each = F.transform(letters, lambda c: F.call_function("instr", s["letters"], c).cast("double"))
        return F.struct(each.alias("x"), F.length(s["letters"]).cast("double").alias("size"))

    def tests(s: Column) -> Column:
        x, size = s["x"], s["size"]
        n = F.greatest(F.size(x), F.lit(2)).cast("double")  # of nothing but = signs none are left
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)), 2))
        chi, df = size * squares / n - n, size - 1
        z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        nexts = F.slice(x, 2, F.size(x))
        pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > size / 2) != (p["b"] > size / 2))) + 1
        high = F.size(F.filter(x, lambda v: v > size / 2)).cast("double")
        low = n - high
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(var > 0, F.abs(turns - mean) / F.sqrt(var)).otherwise(F.lit(12.0))
        centre = (size + 1) / 2
        spread = (size * size - 1) / 12
        together = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - centre) * (p["b"] - centre))
        z_serial = F.abs(together) / (spread * F.sqrt(n - 1))
        least = F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_serial))
        return F.least(F.lit(1.0), 3 * least)

    # transform over one-element arrays names the steps, so that each is computed once.
    steps = F.transform(F.transform(F.transform(F.array(token), parts), codes), tests)
    return F.get(steps, F.lit(0))


def find_spans(docs: DataFrame, language: Language) -> DataFrame:
    """doc_id, the base spans, and the candidates with their length bin, their step on the grid and whether they may be noise."""
    d = id_and_text(docs)
    d = d.withColumns({
        "a": _found(F.col("text"), ASSIGN), "k": _found(F.col("text"), ACCESS), "h": _found(F.col("text"), HEX), "c": _found(F.col("text"), CANDIDATE), "w": _found(F.col("text"), WIDE),
    })
    d = d.withColumn("w", F.when(F.exists("w", lambda t: t.rlike("[_-]")), F.col("w")))
    around = lambda c, pattern: F.when(F.size(c) > 0, F.split("text", pattern, -1))
    d = d.withColumns({
        "values": F.when(F.size("a") > 0, _found(F.col("text"), ASSIGN, 2)),
        "pa": around("a", ASSIGN), "pk": around("k", ACCESS), "ph": around("h", HEX), "pc": around("c", CANDIDATE), "pw": around("w", WIDE),
    })
    places = {n: _places(F.col(n), F.col(f"p{n}")) for n in "akh"}
    assigned = F.filter(places["a"], lambda p, i: F.length(F.get(F.col("values"), i)) >= 8)
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    tokens = lambda c: F.when(F.size(c) > 0, F.zip_with(_places(F.col(c), F.col(f"p{c}")), F.col(c), lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t.alias("token"))))
    keyed = F.concat(F.coalesce(tokens("c"), none), F.coalesce(F.filter(tokens("w"), lambda p: p["token"].rlike("[_-]")), none))
    d = d.select(
        "doc_id",
        _of_kind(assigned, "assign").alias("assign"), _of_kind(places["k"], "access").alias("access"), _of_kind(places["h"], "hex").alias("hex"),
        F.transform(keyed, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), language.p_value(p["token"]).alias("p"), (p_value(p["token"]) >= ALPHA).alias("noise"))).alias("tested"),
    )
    graded = F.transform("tested", lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        F.floor(F.log2((t["end"] - t["start"]).cast("double"))).cast("int").alias("bin"),
        F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) * GRID)).cast("int").alias("step"), t["noise"].alias("noise"),
    ))
    return d.select("doc_id", *(F.coalesce(F.col(n).cast(SPAN), F.array().cast(SPAN)).alias(n) for n in KINDS[:3]), graded.alias("tested"))


def reject_from(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length bin the first grid step whose p-values reject ordinary text (Benjamini-Hochberg)."""
    counts = found.select(F.explode("tested").alias("t")).groupBy("t.bin", "t.step").count()
    of_bin = Window.partitionBy("bin")
    # At most LAST + 1 rows for each of the bins, of which a Spark string allows 31.
    ranked = counts.withColumns({"all": F.sum("count").over(of_bin), "so_far": F.sum("count").over(of_bin.orderBy(F.desc("step")))})
    kept = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / GRID) <= fdr * F.col("so_far") / F.col("all"))
    return {r["bin"]: r["least"] for r in kept.groupBy("bin").agg(F.min("step").alias("least")).collect()}


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row."""
    found = cut(find_spans(docs, learn_language(docs)))
    steps = reject_from(found, fdr)

    def first_rejected(bin_: Column) -> Column:
        out = F.lit(LAST + 1)
        for b, s in steps.items():
            out = F.when(bin_ == b, F.lit(s)).otherwise(out)
        return out

    base = F.sort_array(F.concat("assign", "access", "hex"))
    noise = F.filter("tested", lambda t: t["noise"] & (t["step"] >= first_rejected(t["bin"])) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    inside = lambda t: F.exists("noise", lambda n: (n["start"] <= t["start"]) & (t["end"] <= n["end"]) & (n["end"] - n["start"] > t["end"] - t["start"]))
    names = F.array(*(F.lit(k) for k in KINDS))

    def text_of(spans: str | Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    all_spans = F.sort_array(F.concat("base", F.coalesce(_of_kind(F.filter("noise", lambda t: ~inside(t)), "random").cast(SPAN), F.array().cast(SPAN))))
    return found.withColumn("base", base).withColumn("noise", noise).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text_of("base").cast("binary"), 256).alias("base_sha256"),
        text_of(all_spans).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))
