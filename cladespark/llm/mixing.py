"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, permuted block indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable

#: Words of a block, so that most documents lie in one or two.
BLOCK = 1024
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a multiple of all words, and at most of a source's.
SHARE, MOST = 1.5, 2
#: Slots (blocks) of an output shard.
SHARD_SLOTS = 1024
#: Parts of a source whose sums of sizes are carried on, so that no source is scanned by one task.
CHUNKS = 4096
#: Slots of a source that one row of the draw stands for.
DRAW = 8192
#: Rounds of a permutation.
ROUNDS = 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Narrow rows ``(key, source, doc_id, row, mark, size, chunk)``; ``row`` and ``mark`` tell rows apart by id and text.
    Rows without an id, which may be many copies of one text, are dealt over the chunks by their place in the table."""
    s = F.col(source).cast("string")
    row, mark = F.xxhash64(F.col(id_col)), F.xxhash64(text)
    spread = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    chunk = F.pmod(F.xxhash64(row, mark, spread), F.lit(CHUNKS))
    return docs.select(F.coalesce(F.concat(F.lit("s"), s), F.lit("n")).alias("key"), s.alias("source"), F.col(id_col).alias("doc_id"), row.alias("row"), mark.alias("mark"), n_words(F.col(text)).alias("size"), chunk.alias("chunk"))


def targets(chunks: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(key, source_size, target)``: one row per source.

    Weights go round the sources by code point, null last. Filling to one level per weight gives what resharing the
    excess over ``most`` times a source's size comes to: sources ordered by cap over weight fill up first, and all
    others get the rest by weight. The windows hold one row per source, not per document, and are one task's work.
    """
    sums = chunks.groupBy("key").agg(F.first("source").alias("source"), F.sum("part").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    base = sums.withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    base = base.withColumns({"left": left, "rest": rest, "at": F.row_number().over(order)})
    base = base.withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest"))
    level = F.min(F.when(~F.col("full"), F.struct("at", "left", "rest"))).over(every)
    return base.withColumn("level", level).select("key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.rest")).alias("target"))


def permuted(x: Column, n: Column, *keys: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0 to ``n`` - 1, chosen by ``keys``, takes ``x``; or with ``back`` what it takes there.

    A swap-or-not shuffle: each round draws a pivot, pairs every number with the pivot less it (mod n), and a bit drawn for
    the pair says whether the two change places. So every round is a permutation of exactly these numbers whatever n is
    and its own inverse, and nothing grows beyond 2 n.
    """

    def turn(at: Column, r: Column) -> Column:
        pivot = F.pmod(F.xxhash64(*keys, r), n)
        other = F.pmod(pivot + n - at, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(at, other), pivot).bitwiseAND(F.lit(1).cast("long")) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def slots(sources: DataFrame, seed: int = 0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(key, block, shard, place, take)``: a row for each block that the mix takes, each time that it takes it.

    A source has as many slots as its target needs. All slots of all sources are numbered, one permutation deals the numbers
    out, and each ``shard_slots`` of them in the new order are an output shard. So shards are of one size, and how many
    slots of each source a shard has is a multinomial draw by the targets, given that the totals meet them (that is,
    without replacement). Within a source a slot's number runs through one permutation of the block indices after another,
    and the last slot takes as many words as are still wanted, so a source's words are its target, rounded.
    """
    size, target = F.col("source_size"), F.col("target")
    epochs = F.coalesce(F.floor(F.try_divide(target, size)), F.lit(0).cast("long"))  # a source without words has no slots
    plan = sources.select("key", size.alias("size"), F.greatest(F.ceil(size / block), F.lit(1).cast("long")).alias("blocks"), epochs.alias("epochs"), (F.round(target).cast("long") - epochs * size).alias("more"))
    # The last block of a source may be short. The permutation says whether it is among the extra blocks, and what they hold then.
    short = plan.withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("key"), F.col("epochs"), back=True)).withColumn("lack", F.col("blocks") * block - F.col("size"))
    held = lambda k: k * block - F.when(F.col("tail_at") < k, F.col("lack")).otherwise(0)
    least = F.ceil(F.greatest("more", F.lit(0)) / block)
    plan = short.withColumn("extra", F.when(held(least) < F.col("more"), least + 1).otherwise(least)).withColumn("rest", F.col("more") - held(F.col("extra") - 1))
    plan = plan.withColumn("n", F.col("epochs") * F.col("blocks") + F.col("extra")).filter("n > 0")
    every = W.partitionBy(F.lit(0))  # a row for each source
    plan = plan.withColumn("all", F.sum("n").over(every)).withColumn("offset", F.sum("n").over(every.orderBy("key")) - F.col("n"))
    runs = plan.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(DRAW).cast("long")))).repartition("key", "run")
    drawn = runs.withColumn("i", F.explode(F.sequence("run", F.least(F.col("run") + DRAW, "n") - 1)))
    drawn = drawn.withColumn("epoch", F.floor(F.col("i") / F.col("blocks"))).withColumn("at", F.col("i") % F.col("blocks"))
    to = permuted(F.col("offset") + F.col("i"), F.col("all"), F.lit(seed))
    last = (F.col("epoch") == F.col("epochs")) & (F.col("at") == F.col("extra") - 1)
    return drawn.withColumn("to", to).select(
        "key", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("key"), F.col("epoch")).alias("block"), F.floor(F.col("to") / shard_slots).alias("shard"), (F.col("to") % shard_slots).alias("place"),
        F.when(last, F.col("rest")).otherwise(block).alias("take"),
    )


def shard_counts(plan: DataFrame) -> DataFrame:
    """``(shard, key, slots, words)``: what each output shard draws from each source, from a ``plan``."""
    return plan.filter("words > 0").groupBy("shard", "key").agg(F.count_distinct("place").alias("slots"), F.sum("words").alias("words"))


def plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 0, block: int = BLOCK, weights=WEIGHTS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """A row for each part of a document in a block and each time that the mix takes it, from narrow rows alone.

    The words of a source are one stream, cut into blocks. A document's place in it is the sum of the sizes before it:
    of whole chunks first, then within its chunk. Parts that are not taken, and documents without words, have a null
    ``shard``.
    """
    rows = durable(sized(docs, text, id_col, source))
    chunks = rows.groupBy("key", "chunk").agg(F.first("source").alias("source"), F.sum("size").alias("part"))
    sources = durable(targets(chunks, weights))
    by_chunk = chunks.withColumn("before", F.sum("part").over(W.partitionBy("key").orderBy("chunk")) - F.col("part")).join(sources, "key").select("key", "chunk", "before", "source_size", "target")
    within = W.partitionBy("key", "chunk").orderBy("row", "size", "mark")
    placed = rows.join(by_chunk, ["key", "chunk"]).withColumn("off", F.col("before") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("no", F.row_number().over(within))
    first, last = F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block)
    parts = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    start = F.col("block") * block
    parts = parts.withColumn("lo", F.greatest(F.col("off") - start, F.lit(0))).withColumn("hi", F.least(F.col("off") + F.col("size") - start, F.lit(block))).withColumn("from", F.greatest(start - F.col("off"), F.lit(0)))
    # A merge join: slots are exploded from a few rows, whose size would let the planner broadcast them all.
    return parts.join(slots(sources, seed, block, shard_slots).hint("merge"), ["key", "block"], "left").withColumn("words", F.when(F.col("take").isNull(), 0).otherwise(F.greatest(F.least("hi", "take") - F.col("lo"), F.lit(0))))


def taken(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``.

    ``taken`` are the words that the mix takes of it, repeats counted: no more than twice its size, and over a source
    its target, rounded. Null texts have size 0, and null sources are one source, the last; repeated rows
    stand side by side; with no words at all every target is 0; other columns are ignored.
    """
    return plan(docs, **how).groupBy("key", "chunk", "no", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


#: Columns that tell where a part of a document comes from and lies: its first word in the document, how many words it has,
#: the output shard, the slot of the shard and the word of the slot that it starts at.
PLACES = ["from_word", "n_words", "shard", "place", "at_word"]


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", chars: str = "n_chars", places: bool = False, **how) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a row for each part of a document that a slot of the mix has.

    Rows are laid out by shard, in the order of slots and of words in a slot, so that what reads a partition in order gets
    whole shards; all parts of a shard are in one partition. With ``places`` the columns PLACES follow (those of ``docs``
    with such names are left out), by which documents can be put together again. The text is cut between words and keeps
    the white space after each (and before the first); ``chars``, where there is such a column, is its new length. Null
    texts and documents without words give no rows; repeated rows are mixed as often; rows without an id are told apart
    by text; an empty table gives no rows; other columns pass through. Texts move twice: to their plan, where they are cut,
    and to their shard. The words of one text are an array while it is cut, so it must fit in a task with some 50 bytes a
    word.
    """
    p = plan(docs, text, id_col, source, **how).filter("words > 0")
    cut_of = F.struct("shard", "place", "lo", "from", "words")
    lists = p.groupBy("key", "chunk", "no", "row", "size", "mark").agg(F.collect_list(cut_of).alias("cuts"))
    # Rows that agree in id, source and text are told apart by their number; all else joins one to one.
    lists = lists.withColumn("__no", F.row_number().over(W.partitionBy("row", "mark", "key", "chunk").orderBy("no"))).select(*[F.col(c).alias("__" + c + "2") for c in ("row", "key", "mark", "chunk")], F.col("__no").alias("__no2"), F.sort_array("cuts").alias("__cuts"))
    s = F.col(source).cast("string")
    spread = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    keyed = docs.withColumns({"__row": F.xxhash64(F.col(id_col)), "__mark": F.xxhash64(text), "__key": F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))})
    keyed = keyed.withColumn("__chunk", F.pmod(F.xxhash64("__row", "__mark", spread), F.lit(CHUNKS)))
    keyed = keyed.withColumn("__no", F.row_number().over(W.partitionBy("__row", "__mark", "__key", "__chunk").orderBy(F.lit(0))))
    names = ("__row", "__mark", "__key", "__chunk", "__no")
    both = keyed.join(lists, [F.col(n) == F.col(n + "2") for n in names])
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = both.withColumn("__words", words).withColumn("__cut", F.explode("__cuts"))
    piece = F.array_join(F.slice("__words", (F.col("__cut.from") + 1).cast("int"), F.col("__cut.words").cast("int")), "")
    out = cut.withColumn(text, piece)
    if chars in docs.columns:
        out = out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    kept = [c for c in docs.columns if not (places and c in PLACES)]
    where = [F.col("__cut." + c).alias("__p_" + n) for c, n in zip(("from", "words", "shard", "place", "lo"), PLACES, strict=True)]
    laid = out.select(*kept, *where).repartition("__p_shard").sortWithinPartitions("__p_shard", "__p_place", "__p_at_word")
    return laid.select(*kept, *([F.col("__p_" + n).alias(n) for n in PLACES] if places else []))
