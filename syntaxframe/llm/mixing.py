"""Mixing sources to target weights, in DataFrame functions only.

The words of each source are packed, document after document, into blocks of BLOCK words. Sources get targets by weight,
none above MAX_EPOCHS times its own size (water-filling). The mix has as many slots of BLOCK words as the targets
need, dealt over output shards of SHARD_SLOTS slots. Every slot draws its source by the inverse of the targets' running
sum at a seeded uniform number, so each shard's source counts are a multinomial draw. The counts of a shard get their
place among all draws of their source by running offsets, and a source's k-th draw takes the block at k's image under
the source's own pseudorandom permutation (every pass over a source uses each block once); draws and blocks are joined
by block index. The permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012), exact on any number of
items, and reruns agree.

Free draws miss their totals by about the square root of the slots. So the draws of a source beyond its target (spread over
the shards by hash) go to the sources that fell short of theirs, in order: totals then meet the targets to one block, no
source passes MAX_EPOCHS, and all other slots keep the source that they drew.

Heavy groups: running totals within a source are built in two levels (over documents, and over shards), and joins are by
(source, block), so a source with a third of all rows is spread evenly. Sources are numbered in range partitions. The
running sums of at most LOOKUP_SOURCES sources are an array in the plan, searched by halves; those of more sources are
joined to the draws by stretches of SHARD_SLOTS places, of which none meets more than SHARD_SLOTS + 1 sources.

Defined results for odd input: a null or empty text has size 0 and is taken 0 times; documents without a source form one
source, last in order; ids may be null or repeated (each row is its own document); sources of size 0 have target 0; an empty
table gives an empty mix; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 32
SHARD_SLOTS = 4096
MAX_EPOCHS = 3
#: Sources whose running sums are looked up in an array; more are joined.
LOOKUP_SOURCES = 16_384
ROUNDS = 24
SEED = 20240229
#: Weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Image of x in [0, n) under the permutation that key names."""

    def swap_or_not(x: Column, step: Column) -> Column:
        # Reduced before the subtraction, which could overflow otherwise.
        partner = F.pmod(F.pmod(F.xxhash64(key, step, F.lit(SEED)), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), key, step) % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap_or_not)


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with part and rank: rows numbered from 0 in the given order, by range partitions."""
    parts = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    sizes = parts.groupBy("part").agg(F.count("*").alias("base"))
    # One row for each range partition.
    sizes = sizes.select("part", (F.sum("base").over(Window.orderBy("part")) - F.col("base")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(sizes), "part").withColumn("rank", (F.col("base") + inside - 1).cast("long")).drop("base")


def _with_start(df: DataFrame, size: str, start: str) -> DataFrame:
    """df(part, rank, ...) with the sum of a column over all rows of smaller rank."""
    sums = df.groupBy("part").agg(F.sum(size).alias("base"))
    sums = sums.select("part", (F.sum("base").over(Window.orderBy("part")) - F.col("base")).alias("base"))
    inside = F.sum(size).over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return df.join(F.broadcast(sums), "part").withColumn(start, F.col("base") + inside - F.col(size)).drop("base")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n_docs, source_size) to the same with part, rank, weight and target. One row a source.

    Targets are min(cap, level * weight). The level starts as everything over all weights; while it puts sources above
    their caps, these are capped and the rest is shared anew. Each round is one aggregation and caps a source at least.
    """
    ranked = _numbered(sizes, [F.col("source").asc_nulls_last()], "ranked")
    choice = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        choice = F.when(F.col("rank") % len(weights) == i, float(w)).otherwise(choice)
    ranked = ranked.withColumn("weight", choice).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level, capped = -1.0, 0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("caps"),
            F.sum(F.when(~over, F.col("weight"))).alias("weights"), F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if not sums.weights or (level >= 0 and sums.capped == capped):
            break
        level, capped = (sums.total - (sums.caps or 0.0)) / sums.weights, sums.capped
    return ranked.withColumn("target", F.least("cap", F.lit(max(level, 0.0)) * F.col("weight"))).drop("cap")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text, row) as (rows with their word range in their source, sources with sizes and targets).

    A document's place depends on its id and text alone, so reruns agree however the input is split.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), "row", F.xxhash64("doc_id", "text").alias("mark"))
    sized = written(sized, "sizes")
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    sources = written(source_targets(sources), "sources")
    known = sources.select(F.col("source").alias("s"), "rank", "n_docs", "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    pieces = F.ceil(F.col("n_docs") / F.greatest(F.lit(256.0), F.sqrt("n_docs"))).cast("long")
    rows = rows.withColumn("piece", F.pmod(F.col("mark"), pieces))
    sums = rows.groupBy("rank", "piece").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("rank", "piece", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(bases, ["rank", "piece"])
    inside = Window.partitionBy("rank", "piece").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("start", start).drop("base", "piece", "mark"), sources


def _owners(places: DataFrame, ranges: DataFrame, step: int) -> DataFrame:
    """places(at, ...) with rank and start of the range that holds at. ranges(rank, start, size): disjoint, from 0, without gaps."""
    spark = places.sparkSession
    ranges = ranges.where("size > 0")
    held = ranges.select("start", "rank").orderBy("start").limit(LOOKUP_SOURCES + 1).collect()
    if not held:
        return places.withColumns({"rank": F.lit(None).cast("long"), "start": F.lit(None).cast("long")}).where("false")
    if len(held) <= LOOKUP_SOURCES:
        # Bounded by LOOKUP_SOURCES: constants of the plan, searched by halves.
        starts, ranks = (F.split(F.lit(",".join(str(r[i]) for r in held)), ",").cast("array<bigint>") for i in (0, 1))
        halve = lambda low, half: F.when(F.coalesce(F.get(starts, (low + half).cast("int")) <= F.col("at"), F.lit(False)), low + half).otherwise(low)
        halves = [1 << i for i in reversed(range(max(len(held) - 1, 0).bit_length()))]
        found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), halve) if halves else F.lit(0)
        return places.withColumn("found", found).withColumns({"rank": F.get(ranks, F.col("found")), "start": F.get(starts, F.col("found"))}).drop("found")
    # Two steps, so that no row expands into more than some thousand.
    wide = step * step
    cut = lambda df, size: df.select("rank", "start", "size", F.explode(F.expr(f"sequence(low div {size}, high div {size})")).alias("cell"))
    wider = cut(ranges.select("*", F.col("start").alias("low"), (F.col("start") + F.col("size") - 1).alias("high")), wide)
    wider = wider.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "rank")
    low, high = F.greatest("start", F.col("cell") * wide), F.least(F.col("start") + F.col("size") - 1, F.col("cell") * wide + wide - 1)
    cells = cut(wider.select("rank", "start", "size", low.alias("low"), high.alias("high")), step)
    joined = places.withColumn("cell", F.expr(f"at div {step}")).join(cells.hint("merge"), "cell")
    return joined.where("at >= start and at < start + size").drop("cell", "size")


def shard_counts(sources: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, rank, slots): the multinomial draw of every output shard, as the slots that fell to each source.

    sources(rank, start, want): every slot draws one of total places with replacement, hence a source with chance want / total.
    """
    shards = sources.sparkSession.range(-(-total // shard_slots)).withColumnRenamed("id", "shard")
    slots = shards.withColumn("slot", F.explode(F.expr(f"sequence(shard * {shard_slots}, least((shard + 1) * {shard_slots}, {total}L) - 1)")))
    drawn = slots.withColumn("at", F.pmod(F.xxhash64("slot", F.lit(SEED)), F.lit(max(total, 1)).cast("long")))
    drawn = _owners(drawn, sources.select("rank", "start", F.col("want").alias("size")), shard_slots)
    return drawn.groupBy("shard", "rank").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def slots_of(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, rank, epoch, block): what each slot of the mix takes. sources as from source_targets."""
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    # Rounding up could pass the epochs allowed; the last pass is whole at most.
    want = F.least(F.round(F.col("target") * n_blocks / F.col("source_size")), n_blocks * MAX_EPOCHS).cast("long")
    plan = sources.where("source_size > 0").select("part", "rank", n_blocks.alias("n_blocks"), want.alias("want"))
    plan = written(_with_start(plan, "want", "start"), "slots")
    total = plan.agg(F.sum("want")).first()[0] or 0
    counts = written(shard_counts(plan, total, shard_slots).withColumn("n", F.size("slots").cast("long")), "shard-counts")

    # Each source's draws in an order of its own over the shards, in two levels.
    pieces = max(1, int((total / shard_slots) ** 0.5))
    place = F.xxhash64("shard", "rank")
    counts = counts.withColumn("piece", F.pmod(place, F.lit(pieces)))
    sums = counts.groupBy("rank", "piece").agg(F.sum("n").alias("n"))
    until = Window.partitionBy("rank").orderBy("piece")
    bases = sums.select("rank", "piece", (F.sum("n").over(until) - F.col("n")).alias("base"))
    inside = Window.partitionBy("rank", "piece").orderBy(place, "shard")
    first = F.col("base") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.join(bases, ["rank", "piece"]).select("shard", "rank", "slots", "n", first.alias("first"))

    # Totals: what a source drew, too much or too little.
    drew = sums.groupBy("rank").agg(F.sum("n").alias("drew"))
    settled = plan.join(drew, "rank", "left").withColumn("drew", F.coalesce("drew", F.lit(0)))
    settled = settled.withColumns({"over": F.greatest(F.col("drew") - F.col("want"), F.lit(0)), "under": F.greatest(F.col("want") - F.col("drew"), F.lit(0))})
    settled = _with_start(_with_start(settled.drop("start"), "over", "over_start"), "under", "under_start")
    settled = written(settled.drop("part"), "settled")

    known = counts.join(settled.select("rank", "n_blocks", "want", "over_start"), "rank")
    # Each row becomes up to shard_slots of them: a number of partitions of its own, which adaptive execution does not lower.
    known = known.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "rank")
    draws = known.select("shard", "rank", "n_blocks", "want", "over_start", "first", F.posexplode("slots").alias("i", "slot"))
    draws = draws.withColumn("draw", F.col("first") + F.col("i"))
    stay = draws.where("draw < want").select("shard", "slot", "rank", "n_blocks", "draw")
    spare = draws.where("draw >= want").select("shard", "slot", (F.col("over_start") + F.col("draw") - F.col("want")).alias("at"))
    moved = _owners(spare, settled.select("rank", F.col("under_start").alias("start"), F.col("under").alias("size")), shard_slots)
    moved = moved.join(settled.select("rank", "n_blocks", "drew"), "rank")
    moved = moved.select("shard", "slot", "rank", "n_blocks", (F.col("drew") + F.col("at") - F.col("start")).alias("draw"))
    out = stay.unionByName(moved)
    taken = permuted(F.col("draw") % F.col("n_blocks"), F.col("n_blocks"), F.col("rank"))
    return out.select("shard", "slot", "rank", F.floor(F.col("draw") / F.col("n_blocks")).alias("epoch"), taken.alias("block"))


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows with a word range, as one row for each block they reach into: words from and to within the document."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    out = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    low = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    return out.withColumn("word_from", low).withColumn("word_to", high)


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, source, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.monotonically_increasing_id().alias("row"))
    rows, sources = placed(docs)
    rows = written(rows, "placed")
    drawn = slots_of(sources).groupBy("rank", "block").agg(F.count("*").alias("times"))
    # The planner takes exploded rows for as few as they came from, and would broadcast them: ask for a merge.
    used = blocks_of(rows.select("row", "rank", "start", "size")).join(drawn.hint("merge"), ["rank", "block"])
    taken = used.groupBy("row").agg(F.sum((F.col("word_to") - F.col("word_from")) * F.col("times")).alias("taken"))
    out = rows.join(taken.hint("merge"), "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: (shard, slot, part, doc_id, text), a block's parts in the order of their documents.

    A part is the stretch of a document that lies in the block; words are joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.monotonically_increasing_id().alias("row"))
    docs = written(docs, "texts")
    rows, sources = placed(docs)
    parts = blocks_of(rows).select("rank", "block", "start", "row", "word_from", "word_to")
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("word_from") + 1).cast("int"), (F.col("word_to") - F.col("word_from")).cast("int")), " ")
    parts = parts.join(docs.select("row", "doc_id", "text").hint("merge"), "row").select("rank", "block", "start", "doc_id", cut.alias("text"))
    return slots_of(sources).join(parts.hint("merge"), ["rank", "block"]).select("shard", "slot", F.col("start").alias("part"), "doc_id", "text")
