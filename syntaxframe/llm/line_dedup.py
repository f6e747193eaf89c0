"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its sequence of words. Two lines are near if one word inserted, deleted or replaced (or nothing) turns one into
the other. A line of at least MIN_WORDS words is removed if an equal or near line stands earlier (by document id, then line
number); the earliest stays. On request (short), shorter lines are removed too, if an equal one stands earlier.

Each line emits its deletion variants as hashed keys: the line without its i-th word, for every i, and the line itself.
Lines with the same variant and the same i differ in word i at most; a line that is another's variant lacks one of its
words. So each key needs only its earliest line, never the pairs of its group: the earliest beats all others. Each loser
is then verified against its winner, word for word; one that fails this (its key is a collision of hashes) is compared with
the other earlier lines of its keys.

Only lines that can have a partner emit variants: two lines one edit apart agree in their first or their last half
(pigeonhole), so lines that share neither half with another line are left out first; this loses nothing.

Heavy groups: equal lines are merged by partial aggregation before any join; keys are settled by grouped minima; joins of
occurrences with a hot line are split by adaptive execution.

Defined results for odd input: a null text stays null, an empty one empty; blank lines always stay, and short ones unless asked for; a null id counts
as larger than every other; rows with equal id and equal text get equal results; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, last_if_null, written

MIN_WORDS = 5
#: Lengths that share a pair of halves, in words.
STEP = 8
#: Bytes of hashes sent to all executors, as they lie in memory; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: What a row takes in a table of a join beside its columns, and what a column or an array's value takes.
ROW_BYTES, COLUMN_BYTES = 48, 8
#: Variants of lines of up to so many words are made inside the row; those of longer lines by a running window over words.
ROW_WORDS = 8192
#: Words whose running values are made in one array. Arrays grow by copying, so long lines are worked on in blocks.
BLOCK_WORDS = 64

_AT = ["k_id", "k_text", "no"]


def plain(line: Column) -> Column:
    """The line's words with one space between them. Lines that are so already are left alone."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r") | line.contains("  ")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(last_if_null(F.col(id_col)).alias("k_id"), F.xxhash64(text_col).alias("k_text"), F.col(text_col).alias("text"))


def _lines(docs: DataFrame, text_col: str, id_col: str, short: bool = False) -> DataFrame:
    """(k_id, k_text, no, line, n) of every line with enough words (short: with any)."""
    out = _keyed(docs, text_col, id_col).select("k_id", "k_text", F.posexplode(F.transform(F.split("text", "\n"), plain)).alias("no", "line"))
    # A line has more words than its part before the (MIN_WORDS - 1)th space, if that part is not all of it.
    out = out.where(F.col("line") != "" if short else F.substring_index("line", " ", MIN_WORDS - 1) != F.col("line"))
    return out.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def _fetched(docs: DataFrame, text_col: str, id_col: str, places: DataFrame) -> DataFrame:
    """(k_id, k_text, no, line, n) of the lines at places(k_id, k_text, no)."""
    wanted = written(places.groupBy("k_id", "k_text").agg(F.collect_set("no").alias("wanted")), "wanted-lines")
    found = _joined(_keyed(docs, text_col, id_col), wanted, ["k_id", "k_text"], values=places.count()).withColumn("lines", F.split("text", "\n"))
    each = F.transform("wanted", lambda i: F.struct(i.alias("no"), plain(F.element_at(F.col("lines"), i + 1)).alias("line")))
    out = found.select("k_id", "k_text", F.inline(each))
    return out.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def _half_keys() -> dict[str, Column]:
    """Keys of a line's halves: for its own length class, and for the class below if a line one word shorter is in it."""
    out = {}
    for name, reach, present in (("own", f"(n - n % {STEP})", "true"), ("below", f"(n - n % {STEP} - {STEP})", f"n % {STEP} = 0")):
        # The class of the shortest lines has halves of two words.
        half = f"cast(greatest({reach} div 2, 2) as int)"
        for side, sign in (("head", ""), ("tail", "-")):
            out[f"{name}_{side}"] = F.expr(f"if({present}, xxhash64(substring_index(line, ' ', {sign}{half}), {reach}, '{side}'), null)")
    return out


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", values: int | None = None) -> DataFrame:
    """A join with a written table, broadcast if it is small. values: how many its arrays hold, where it has some."""
    rows = right.count() if values is None else values
    size = rows * (ROW_BYTES + COLUMN_BYTES * (len(right.columns) + ("at" in right.columns) * len(_AT)))
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, on, how)


def _near(a: Column, b: Column) -> Column:
    """Is b at most one inserted, deleted or replaced word away from a?"""

    def agree(x: Column, y: Column) -> Column:
        first_off = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(first_off == 0, F.least(F.size(x), F.size(y))).otherwise(first_off - 1)

    most = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= most - 1)


def _running(words: DataFrame, values: str, name: str) -> DataFrame:
    """words with an array more: the exclusive or of the first k values, k from 0. Each block by itself, then the blocks' ends: a line of n words
    copies some n * BLOCK_WORDS / 2 values in all, where one array over the line would copy n * n / 2."""
    along = "aggregate({}, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) ^ {})))"
    last = f"size({values}) - 1"
    block = along.format(f"sequence(b, least(b + {BLOCK_WORDS - 1}, {last}))", f"{values}[x]")
    out = words.withColumn("_blocks", F.expr(f"transform(sequence(0, {last}, {BLOCK_WORDS}), b -> {block})"))
    out = out.withColumn("_ends", F.expr(along.format("transform(_blocks, b -> element_at(b, -1))", "x")))
    whole = "flatten(transform(_blocks, (b, k) -> transform(slice(b, 1, size(b) - 1), x -> x ^ _ends[k])))"
    return out.withColumn(name, F.expr(f"concat({whole}, array(element_at(_ends, -1)))")).drop("_blocks", "_ends")


def _variants(texts: DataFrame) -> DataFrame:
    """(k_id, k_text, no, i, key): lines without their i-th word, and (i = -1) whole. Order counts in a key: it is the
    exclusive or of each word hashed with its place."""
    words = texts.withColumn("words", F.split("line", " "))
    short = words.where(F.col("n") <= ROW_WORDS)
    short = short.withColumns(
        {"here": F.transform("words", lambda w, i: F.xxhash64(w, i)), "left": F.transform("words", lambda w, i: F.xxhash64(w, i - 1))}
    )
    for values, name in (("here", "before"), ("left", "upto")):
        short = _running(short, values, name)
    each = "transform(sequence(0, n - 1), i -> struct(i, before[i] ^ upto[n] ^ upto[i + 1] as key))"
    each = f"concat({each}, array(struct(-1 as i, before[n] as key)))"
    short = short.select(*_AT, F.inline(F.expr(each))).select(*_AT, "i", "key")

    word = words.where(F.col("n") > ROW_WORDS).select(*_AT, F.posexplode("words").alias("i", "word"))
    word = word.select(*_AT, "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("left"))
    line = Window.partitionBy(*_AT).orderBy("i")
    before = F.coalesce(F.expr("bit_xor(here)").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.expr("bit_xor(left)").over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    gone = word.select(*_AT, "i", before.bitwiseXOR(after).alias("key"))
    whole = word.groupBy(*_AT).agg(F.expr("bit_xor(here)").alias("key")).select(*_AT, F.lit(-1).alias("i"), "key")
    return short.unionByName(gone).unionByName(whole)


def losing_lines(seen: DataFrame, firsts: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k_id, k_text, no) of first occurrences of distinct lines that have a near line standing earlier.

    seen: all lines with h1 and the keys of their halves; firsts: (h1, h2, at) of distinct lines; fetch: from places to
    lines with their words.
    """
    keys = F.filter(F.array(*_half_keys()), lambda k: k.isNotNull())
    halves = seen.select("h1", F.explode(keys).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    shared = written(shared.select("half"), "halves")
    chosen = written(_joined(halves, shared, ["half"], "left_semi").select("h1").distinct(), "candidates")
    places = written(_joined(firsts, chosen, ["h1"], "left_semi").select("at.*"), "candidate-places")
    texts = written(fetch(places).dropDuplicates(_AT), "candidate-lines")

    variants = written(_variants(texts), "variants")
    at = F.struct(*_AT)
    common = variants.groupBy("key").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("key")
    common = written(common, "variant-keys")
    variants = written(_joined(variants, common, ["key"], "left_semi").select("key", "i", at.alias("at")), "common-variants")
    # Replaced words: among lines without their i-th word, the earliest. Missing words: i = -1 against all the others.
    # The minima are written, so that joins with them are plain ones, whose hot keys adaptive execution splits.
    by_place = written(variants.groupBy("key", "i").agg(F.min("at").alias("first")), "variant-places")
    by_key = by_place.groupBy("key").agg(
        F.min(F.when(F.col("i") == -1, F.col("first"))).alias("short"), F.min(F.when(F.col("i") >= 0, F.col("first"))).alias("long")
    )
    by_key = written(by_key.where("short is not null and long is not null"), "variant-lengths")
    by_replacing = variants.join(by_place.where("i >= 0"), ["key", "i"]).select("at", "first")
    rival = F.when(F.col("i") == -1, F.col("long")).otherwise(F.col("short"))
    by_missing = variants.join(by_key, "key").select("at", rival.alias("first"))
    beaten = by_replacing.unionByName(by_missing).where("first < at").groupBy("at").agg(F.min("first").alias("first"))
    beaten = written(beaten, "beaten-lines")
    # The check, word for word.
    words = texts.select(at.alias("at"), F.split("line", " ").alias("words"))
    other = words.select(F.col("at").alias("first"), F.col("words").alias("other"))
    checked = beaten.join(words, "at").join(other, "first").select("at", "first", _near(F.col("words"), F.col("other")).alias("near"))
    checked = written(checked, "checked-lines")
    # Two lines far apart with one key (a collision): the loser is compared with the other earlier lines of its keys.
    failed = checked.where("not near").select("at")
    if failed.isEmpty():
        return checked.select("at.*")
    asked = variants.join(failed, "at").select("key", "i", "at")
    rivals = variants.select("key", F.col("i").alias("j"), F.col("at").alias("first"))
    fits = "first < at and if(i = -1, j >= 0, j = i or j = -1)"
    more = asked.join(rivals, "key").where(fits).select("at", "first").distinct()
    more = more.join(words, "at").join(other, "first").where(_near(F.col("words"), F.col("other")))
    return checked.where("near").select("at.*").unionByName(more.select("at").distinct().select("at.*"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(k_id, k_text, gone): for each document that loses lines, their numbers from 0, ascending."""
    lines = _lines(docs, text_col, id_col, short)
    # Without halves, short lines have no near ones.
    halves = {k: F.when(F.col("n") >= MIN_WORDS, c) for k, c in _half_keys().items()}
    seen = lines.select(*_AT, F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), *(c.alias(k) for k, c in halves.items()))
    seen = written(seen, "lines")
    at = F.struct(*_AT)
    firsts = written(seen.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("times")), "distinct-lines")
    lost = written(losing_lines(seen, firsts, lambda places: _fetched(docs, text_col, id_col, places)), "losing-lines").select(at.alias("at"), F.lit(True).alias("lost"))
    acting = firsts.join(lost, "at", "left").where("lost or times > 1")
    acting = written(acting.select("h1", "h2", F.col("at").alias("first"), F.coalesce("lost", F.lit(False)).alias("lost")), "acting-lines")
    gone = _joined(seen.select("h1", "h2", *_AT), acting, ["h1", "h2"]).where(F.col("lost") | (at != F.col("first")))
    # Equal rows (same id, same text) name a line twice.
    return gone.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with near-duplicate lines taken out of the texts, and two more columns at the end: _n_lines and _n_removed (with further
    underscores before them where docs has these names)."""
    names = docs.columns
    id_key, text_key, gone_col, n_lines_col, n_removed_col = fresh(names, "k_id", "k_text", "gone", "_n_lines", "_n_removed")
    gone = removed_lines(docs, id_col, text_col, short).toDF(id_key, text_key, gone_col)
    keyed = docs.withColumns({id_key: last_if_null(F.col(id_col)), text_key: F.xxhash64(text_col)})
    joined = keyed.join(gone, [id_key, text_key], "left")
    # A column of its own: within the lambda the text would be split again for every line.
    (lines_col,) = fresh([*joined.columns, n_lines_col, n_removed_col], "lines")
    joined = joined.withColumn(lines_col, F.split(text_col, "\n"))
    lines, cuts = F.col(lines_col), F.col(gone_col)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cuts), lambda i: F.get(lines, i))
    text = F.when(cuts.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*out, n_lines.alias(n_lines_col), F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias(n_removed_col))
