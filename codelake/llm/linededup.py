"""Operator 2: repeated lines and passages, found by content-defined chunks of lines.

A text is cut at its line ends. A line of more than LONGEST bytes is cut further, into
its words, which are the lines of what follows inside it; a word that is that long (in
scripts that set no blanks: Han, kana, Thai and their like) after any white space and
after each character of every other block of such scripts. Empty lines belong to the
line before them. Each line has a hash.

Chunks come in two kinds. Whole lines: a hash rolls over the hashes of two lines in a
row, from line to line, and a chunk starts at each, so that no shift of what stands
around hides a repeat: all that recurs and is two lines long or longer is found, to the
line. (A mask that let only some lines start a chunk would lose short footers between
other lines; lines are few enough to do without.) Inside long lines a word whose hash
is the least of those up to RADIUS before and behind it starts a chunk of WORDS words,
as do the line's first word and its WORDS-th from the end. Where chunks start there
depends on the words near by and not on what precedes a passage, so it has the same
chunks wherever it stands: one every 2 * RADIUS + 1 words on average, each lapping over
the next. The ends of a passage, some words each, lie in no chunk of its own and stay.

Chunks with a hash that occurs once are left alone. The texts of the others are
compared byte by byte: a hash under which two different texts stand removes nothing.
Of each chunk the first occurrence, by doc_id and place, stays, and the lines of all
others go. Whatever is removed thus still stands somewhere: the lines of the first
occurrence go only where another chunk over them has an earlier one. A single line that
recurs between other lines stays, unless it is long.

Everything is built from Spark's own functions. Null texts count as empty; they and
texts of one short line stay as they are. Rows with a null doc_id come last and are
told apart by their text. Repeated rows get the same result each and count once. Of
rows with one doc_id and other texts, what both hold stays in both. Very long texts are
cut like any other. An empty table gives an empty result. A document may lose all of
its text; it then stays with an empty text. Other columns pass through, whatever their
names are; `n_chars`, if there is one, is set to the new length where the text has
changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, read_table, shared_dir

#: Bytes of a line from which on it is cut into words.
LONGEST = 160
#: Words of a chunk inside a long line, and of the neighbourhood in which its first word has the least hash.
WORDS, RADIUS = 13, 4
#: Ids of rows without a doc_id start here.
_NAMELESS = 1 << 62

# Blocks (first, last, size) of characters that stand without white space; a line may end in every other block.
UNSPACED = ((0x0E00, 0x0EFF, 4), (0x1000, 0x109F, 4), (0x1780, 0x17FF, 4), (0x3040, 0x30FF, 4), (0x3100, 0x9FFF, 256), (0xF900, 0xFAFF, 64), (0x20000, 0x3FFFF, 2048))
EVERY_OTHER = "".join(rf"\x{{{c:X}}}-\x{{{c + n - 1:X}}}" for lo, hi, n in UNSPACED for c in range(lo, hi + 1, 2 * n))


def _wide(words: Column) -> Column:
    return F.exists(words, lambda word: F.octet_length(word) > LONGEST)


def _words(line: Column) -> Column:
    """The words of a long line, a short one as it is."""
    pieces = F.filter(F.split(line, rf"(?<=\s|[{EVERY_OTHER}])"), lambda piece: piece != "")
    # A list of one, so that the line is cut once.
    by_blanks = F.get(F.transform(F.array(F.split(line, " ")), lambda words: F.when(_wide(words), pieces).otherwise(words)), F.lit(0))
    return F.when(F.octet_length(line) > LONGEST, by_blanks).otherwise(F.array(line))


def with_pieces(docs: DataFrame, text: Column) -> DataFrame:
    """Adds `lines` and `pieces`, the words of each line, as columns of their own, so that no line is cut anew for each use."""
    d = docs.withColumn("lines", F.split(text, "\n"))
    return d.withColumn("pieces", F.transform("lines", _words))


def _hash_of(parts: Column) -> Column:
    """Of the words or of the lines of a chunk."""
    return F.xxhash64(F.transform(parts, lambda part: F.xxhash64(part)))


#: A chunk's place in its text, in one number that is short in shuffles: its line, times this, and its first word, or WHOLE and how many lines it has.
_LINE, WHOLE = 1 << 32, 1 << 31


def _line(at: Column) -> Column:
    return F.shiftrightunsigned(at, 32).cast("int")


def _rest(at: Column) -> Column:
    return at.bitwiseAND(F.lit(_LINE - 1))


def _lines(at: Column) -> Column:
    """How many lines a chunk of whole lines has."""
    return (_rest(at) - WHOLE).cast("int")


def _parts(at: Column) -> Column:
    """The words of a chunk, or its lines without empty ones."""
    lines = F.filter(F.slice("lines", _line(at) + 1, _lines(at)), lambda line: line != "")
    return F.when(_rest(at) >= WHOLE, lines).otherwise(F.slice(F.get("pieces", _line(at)), _rest(at).cast("int") + 1, WORDS))


def _identified(docs: DataFrame) -> DataFrame:
    """(uid, row): the caller's columns in a struct, and the doc_id, or a number made of the text where there is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nameless = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(_NAMELESS))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("uid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def chunks(docs: DataFrame) -> DataFrame:
    """(uid, at, h): place and hash of all chunks; docs: (uid, text)."""
    d = docs.select("uid", F.split("text", "\n").alias("lines"))
    d = d.withColumn("full", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.get("lines", k) != ""))
    # Rows take their own line along, not the text's array.
    def row(k: Column, p: Column) -> Column:
        other, after = F.get("full", p + 1), F.coalesce(F.get("full", p + 2), F.size("lines"))
        return F.struct(k.alias("k"), F.get("lines", k).alias("line"), F.xxhash64(F.get("lines", other)).alias("other"), other.isNotNull().alias("pair"), (after - k).alias("n"))

    d = d.select("uid", F.inline(F.transform("full", row)))
    pair = F.when(F.col("pair"), F.xxhash64(F.array(F.xxhash64("line"), "other")))
    hashes = F.when(F.octet_length("line") > LONGEST, F.transform(_words(F.col("line")), lambda word: F.xxhash64(word)))
    d = d.select("uid", "k", F.col("n").alias("lines"), pair.alias("pair"), hashes.alias("hashes"))
    starts = F.when(F.size("hashes") >= WORDS, F.sequence(F.lit(-1), F.size("hashes") - WORDS)).otherwise(F.array(F.lit(-1)))
    d = d.select("uid", "k", "lines", "pair", "hashes", F.explode(starts).alias("w"))
    at = lambda j: F.get("hashes", F.col("w") + j)
    least = F.col("w") >= RADIUS
    for j in range(1, RADIUS + 1):
        least = least & (at(0) < at(-j)) & (at(0) <= at(j))
    d = d.filter(F.when(F.col("w") < 0, F.col("pair").isNotNull()).otherwise((F.col("w") == 0) | (F.col("w") == F.size("hashes") - WORDS) | least))
    whole = F.col("w") < 0
    h = F.when(whole, F.col("pair")).otherwise(F.xxhash64(F.slice("hashes", F.col("w") + 1, WORDS)))
    return d.select("uid", (F.col("k") * F.lit(_LINE) + F.when(whole, F.col("lines") + F.lit(WHOLE)).otherwise(F.col("w"))).alias("at"), h.alias("h"))


def _by_document(found: DataFrame) -> DataFrame:
    """(uid, spans): the chunks (at, h, gone) of each document; found: (uid, at, h, later), later if an earlier document holds the chunk too."""
    of_hash = found.repartition("uid").groupBy("uid", "h").agg(F.collect_set("at").alias("places"), F.min("at").alias("least"), F.bool_or("later").alias("later"))
    gone = lambda at: F.col("later") | (at != F.col("least"))
    spans = F.transform("places", lambda at: F.struct(at.alias("at"), F.col("h").alias("h"), gone(at).alias("gone")))
    return of_hash.select("uid", spans.alias("spans")).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _with_alone(joined: DataFrame) -> DataFrame:
    """Adds `alone`, whether no other row has this one's uid; rows come from a join by uid, which has put them side by side."""
    return joined.withColumn("alone", F.count("*").over(Window.partitionBy("uid")) == 1)


def _confirmed(spans: Column) -> Column:
    """Those of the chunks that stand in `lines`; only a row that shares its doc_id may have others."""
    # Naming them twice, which keeps the optimizer from putting the cutting of all lines in place of the names.
    known = F.size("pieces") == F.size("lines")
    return F.when(known & F.col("alone"), spans).when(known, F.filter(spans, lambda s: _hash_of(_parts(s["at"])) == s["h"]))


def find_repeats(docs: DataFrame) -> DataFrame:
    """(uid, spans) of all documents that have a chunk that recurs; docs as `_identified` gives them."""
    spark = docs.sparkSession
    shared_dir(spark)
    folder = fresh_dir(spark, "chunks")
    chunks(docs.select("uid", F.col("row.text").cast("string").alias("text"))).write.option("compression", "zstd").parquet(folder)
    all_ = spark.read.parquet(folder)
    # Summed up before the shuffle. The result is written, so that the join with it can split a hash that very many documents have.
    again = all_.groupBy("h").agg(F.count("*").alias("times"), F.min("uid").alias("first")).filter("times > 1").select("h", "first")
    again.write.option("compression", "zstd").parquet(f"{folder}-again")
    found = all_.join(spark.read.parquet(f"{folder}-again"), "h").select("uid", "at", "h", (F.col("uid") != F.col("first")).alias("later"))
    # Asks for the whole row, as the join of remove_repeats does, so that both read one shuffle of the texts.
    text = F.get(F.transform(F.array("row"), lambda row: row["text"]), F.lit(0))
    spans = _by_document(found)
    texts = with_pieces(_with_alone(docs.join(spans, "uid")), text.cast("string"))
    texts = texts.select(F.explode(F.transform(_confirmed(F.col("spans")), lambda s: F.struct(s["h"].alias("h"), F.array_join(_parts(s["at"]), "\n").alias("text")))).alias("c"))
    unequal = texts.select("c.h", "c.text").distinct().groupBy("h").count().filter("count > 1").select("h")
    # There are hardly ever any, so they are taken out of the spans, whose shuffle serves twice. All columns are asked for, as above, so that the chunks' shuffle does too.
    unfit = found.join(unequal, "h").groupBy("uid").agg(F.collect_set(F.struct("h", "at", "later")).alias("unfit"))
    fit = F.filter("spans", lambda s: ~F.exists("unfit", lambda u: (u["h"] == s["h"]) & (u["at"] == s["at"]) & u["later"].isNotNull()))
    return spans.join(unfit, "uid", "left").select("uid", F.when(F.col("unfit").isNull(), F.col("spans")).otherwise(fit).alias("spans"))


def _places(k: Column, first: Column, n: Column) -> Column:
    """Of words one after another, each as a chunk's first."""
    start = k.cast("long") * _LINE + first
    return F.sequence(start, start + n - 1)


def _stays() -> Column:
    """Places of the words (short lines are one) of `pieces` that lie in none of the chunks in `gone`."""
    every = F.flatten(F.transform("pieces", lambda words, k: _places(k, F.lit(0), F.size(words))))
    line = lambda k: _places(k, F.lit(0), F.size(F.get("pieces", k)))
    whole = lambda at: F.flatten(F.transform(F.sequence(_line(at), _line(at) + _lines(at) - 1), line))
    lost = F.transform("gone", lambda s: F.when(_rest(s["at"]) >= WHOLE, whole(s["at"])).otherwise(_places(_line(s["at"]), _rest(s["at"]), F.lit(WORDS))))
    return F.array_except(every, F.flatten(lost))


def _joined(stays: Column) -> Column:
    """The text of the words at these places."""
    def piece(place: Column, i: Column) -> Column:
        after, k = F.get(stays, i + 1), _line(place)
        between = F.when(after.isNull(), "").when(_line(after) != k, "\n").otherwise(F.get("glue", k))
        return F.concat(F.get(F.get("pieces", k), _rest(place).cast("int")), between)

    return F.array_join(F.transform(stays, piece), "")


def remove_repeats(docs: DataFrame, report: bool = False, emptied: bool = True) -> DataFrame:
    """The documents with repeated lines cut out of `text`; without `emptied` those go that have nothing but white space left.

    report adds removed_chunks and removed_lines (lines, or words of long ones).
    """
    own = _identified(docs)
    d = _with_alone(own.join(find_repeats(own), "uid", "left"))
    d = with_pieces(d, F.when(F.col("spans").isNotNull(), F.col("row.text").cast("string")))
    d = d.withColumn("gone", F.filter(_confirmed(F.col("spans")), lambda s: s["gone"])).withColumn("stays", F.when(F.size("gone") > 0, _stays()))
    # What stands between the words of each line.
    d = d.withColumn("glue", F.when(F.size("gone") > 0, F.transform("lines", lambda line: F.when(_wide(F.split(line, " ")), "").otherwise(" "))))
    d = d.withColumn("joined", _joined(F.col("stays")))
    # Taken out of a list, so that no condition on the result, here or later, puts all that `joined` is made of in place of its name, for every word.
    blank = F.lit(not emptied) & F.coalesce(F.rlike("joined", F.lit(r"^\s*$")), F.lit(False))
    d = d.select(*(c for c in d.columns if c != "joined"), F.explode(F.when(blank, F.array().cast("array<string>")).otherwise(F.array("joined"))).alias("joined"))
    text = F.coalesce("joined", F.col("row.text").cast("string")).cast(docs.schema["text"].dataType)
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("joined").isNull(), F.col("row.n_chars")).otherwise(F.length("joined").cast(docs.schema["n_chars"].dataType))
    out = [columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    if report:
        out += [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks"), F.coalesce(F.size(F.flatten("pieces")) - F.size("stays"), F.lit(0)).cast("long").alias("removed_lines")]
    return d.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, report=True)
