"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Texts are cut into blocks of words. How many words each source gives follows from its weight; which blocks
give them follows from a permutation of the source's blocks by a hash. The blocks that a source gives, its
quota, are split among the output shards by a tree: each node halves its shards and draws from the
multivariate hypergeometric distribution how many blocks of each source go left. A shard then takes its own
stretch of each source's permutation, so shards are disjoint, and its blocks are shuffled within it.

No source is ever ordered in one task: ranks come from the sizes of hash buckets and the order within a
bucket. Shards hold about SHARD_BLOCKS blocks, so their number follows from the mixture's size. All of it is
SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable
from loomspark.llm.sqlblocks import let

#: Words of a block and hexadecimal digits that number the hash buckets of a source.
BLOCK_WORDS, DIGITS = 256, 3
#: Blocks that a shard holds, and the fewest halvings of the shards.
SHARD_BLOCKS, LEAST_LEVELS = 1 << 16, 4
#: Stretches of shards up to so many (about 40 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_STRETCHES = 500_000
#: Shards whose stretches are summed in one task.
SLICE = 4_096
#: Levels of the tree after which its nodes are written and dealt anew.
TREE_STEP = 6


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_no, source_size, target)``, a row a source, null included.

    Sources in the order of their code points, null last, take the weights in turn. Together they get
    ``share`` of all words. A target above ``most`` times the source is cut there and the excess goes to the
    others by weight, until none is above; in the order of size by weight that is one pass.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sources.withColumn("source_no", F.row_number().over(in_order)).withColumn("weight", F.get(cycle, (F.col("source_no") - 1) % len(weights)))
    full = weighed.withColumn("cap", F.col("source_size") * most)
    tight = Window.orderBy((F.col("cap") / F.col("weight")), "source_no")
    everything = Window.partitionBy(F.lit(1))
    total = share * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(tight.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = full.withColumn("rate", (total - before) / left)
    free = F.when(F.col("weight") * F.col("rate") <= F.col("cap"), F.col("rate"))
    level = F.first(free, ignorenulls=True).over(tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spread = rated.withColumn("level", level)
    fair = F.col("weight") * F.col("level")
    return spread.select("source", "source_no", "source_size", F.when(F.col("level").isNull() | (fair > F.col("cap")), F.col("cap").cast("double")).otherwise(fair).alias("target"))


def _uniform(seed: str, node: Column, source_no: Column) -> tuple[Column, Column]:
    """Two uniform draws of 40 bits each for a source at a node of the tree."""
    digits = F.md5(F.concat_ws(":", F.lit(seed), node.cast("string"), source_no.cast("string")))
    draw = lambda at: (F.conv(F.substring(digits, at, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    return draw(1), draw(11)


def hypergeometric(rest: Column, own: Column, room: Column, u: Column, v: Column) -> Column:
    """How many of ``own`` among ``rest`` blocks are in a random choice of ``room``, by uniform draws u and v.

    The distribution is inverted by its recurrence over eight standard deviations on either side, whatever its
    width; u has 40 bits and v gives the bits below. The steps grow with the root of the blocks: about 40,000
    for 20 million.
    """
    n, q, k = (c.cast("double") for c in (rest, own, room))
    mean = k * q / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (1 - q / F.greatest(n, F.lit(1.0))) * (n - k) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    least, most = F.greatest(F.lit(0.0), k - (n - q)), F.least(q, k)
    shape = F.struct(n.alias("n"), q.alias("q"), k.alias("k"), mean.alias("mean"), spread.alias("spread"), least.alias("least"), most.alias("most"), (u + (v - 0.5) / float(1 << 40)).alias("u"))

    def exact(s: Column) -> Column:
        low = F.greatest(s["least"], F.floor(s["mean"] - 8 * s["spread"] - 1).cast("double")).cast("long")
        high = F.least(s["most"], F.ceil(s["mean"] + 8 * s["spread"] + 1).cast("double")).cast("long")
        ratio = lambda x: (s["q"] - x) * (s["k"] - x) / ((x + 1) * (s["n"] - s["q"] - s["k"] + x + 1))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        grow = lambda a, x: F.struct(F.when(x < s["most"], a["w"] * ratio(x.cast("double"))).otherwise(0.0).alias("w"), (a["sum"] + a["w"]).alias("sum"))

        def find(total: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("at"))
            step = lambda a, x: F.struct(F.when(x < s["most"], a["w"] * ratio(x.cast("double"))).otherwise(0.0).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] + a["w"] < s["u"] * total, x + 1).otherwise(a["at"]).alias("at"))
            return F.least(high, F.aggregate(F.sequence(low, high), begin, step, lambda a: a["at"]))

        return let(F.aggregate(F.sequence(low, high), start, grow, lambda a: a["sum"]), find)

    return let(shape, exact)


def split_quotas(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """``(source_no, shard, first, past)``: the stretch of each source's drawn blocks that each of 2**levels shards takes.

    ``quotas`` has ``source_no`` and ``quota``, a row a source. Shards get equally many blocks, but for one.
    Nodes are numbered like a heap, the root 1.
    """
    packed = F.array_sort(F.collect_list(F.struct("source_no", "quota")))
    root = quotas.agg(packed.alias("q")).where(F.size("q") > 0)
    nodes = root.select(F.lit(1).cast("long").alias("node"), F.transform("q", lambda x: x["source_no"]).alias("sources"), F.transform("q", lambda x: x["quota"]).alias("quotas"))
    for level in range(levels):
        if level and level % TREE_STEP == 0:
            nodes = durable(nodes.repartition("node"), "nodes")

        def draw(acc: Column, x: Column) -> Column:
            u, v = _uniform(seed, acc["node"], F.get(acc["sources"], F.size(acc["taken"])))
            taken = lambda t: F.struct(
                (acc["rest"] - x).alias("rest"), (acc["room"] - t).alias("room"), acc["node"].alias("node"), acc["sources"].alias("sources"), F.concat(acc["taken"], F.array(t)).alias("taken")
            )
            return let(hypergeometric(acc["rest"], x, acc["room"], u, v), taken)

        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor(total / 2).cast("long")
        start = F.struct(total.alias("rest"), half.alias("room"), F.col("node"), F.col("sources"), F.array().cast("array<bigint>").alias("taken"))
        halves = nodes.withColumn("left", F.aggregate("quotas", start, draw, lambda a: a["taken"]))
        left = F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas"))
        nodes = halves.select("sources", F.explode(F.array(left, right)).alias("x")).select("x.node", "sources", "x.quotas")
    each = F.explode(F.arrays_zip("sources", "quotas")).alias("x")
    leaves = nodes.select((F.col("node") - (1 << levels)).alias("shard"), each).select("shard", F.col("x.sources").alias("source_no"), F.col("x.quotas").alias("n"))
    leaves = durable(leaves, "leaves")
    # stretches lie one after the other: those of a slice of shards begin after the slices before
    sliced = leaves.withColumn("slice", F.floor(F.col("shard") / SLICE))
    whole = sliced.groupBy("source_no", "slice").agg(F.sum("n").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("source_no").orderBy("slice")) - F.col("all")
    upto = F.sum("n").over(Window.partitionBy("source_no", "slice").orderBy("shard"))
    placed = sliced.withColumn("upto", upto).join(whole.select("source_no", "slice", earlier.alias("earlier")), ["source_no", "slice"])
    past = F.col("earlier") + F.col("upto")
    return placed.select("source_no", "shard", (past - F.col("n")).alias("first"), past.alias("past"))


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words (runs without ASCII white space) of each document."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shard_blocks: int = SHARD_BLOCKS, block_words: int = BLOCK_WORDS, seed: str = "mix"
) -> tuple[DataFrame, DataFrame]:
    """The dealt blocks, and the documents with their targets.

    Blocks: ``(doc_id, source, block, epoch, first_word, n_words, shard, position)``; ``position`` is the
    block's place in its shard, from 0. Documents: ``(doc_id, source, size, source_no, source_size, target)``.

    ``docs`` has ``doc_id``, ``source`` and ``text``; other columns are left alone. A source's target, rounded
    to whole words, is taken as whole passes over the source and, for the rest, the first blocks of its
    permutation, the last of them cut to fit. So a document gives at most ``most`` times its words. Null and
    empty texts have no words and no blocks. A null source is a source of its own, and rows of a source without
    a doc_id are one document. Rows that repeat a doc_id and source are one document with all their words. An
    empty table gives empty tables. The hash is of doc_id, block and seed, so reruns and retried tasks agree.
    """
    sized = durable(sizes(docs), "sizes")
    targets = durable(source_targets(sized, weights, share, most), "targets")
    placed = sized.join(F.broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])  # a row a source
    goal = F.rint("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    asked = placed.withColumn("epochs", whole).withColumn("extra", goal - F.col("epochs") * F.col("source_size"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words).cast("long")))
    blocks = asked.where("size > 0").select("doc_id", "source", "source_no", "size", "epochs", "extra", numbers.alias("block"))
    blocks = blocks.withColumn("n_words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    hashed = blocks.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("block").cast("string")))).withColumn("bucket", F.substring("key", 1, DIGITS))

    buckets = hashed.groupBy("source_no", "bucket").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.sum("n").over(Window.partitionBy("source_no")).alias("n_blocks"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "source", "block")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hashed.withColumn("upto", F.sum("n_words").over(upto)).withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["source_no", "bucket"])
    rest = F.col("extra") - F.col("words_before") - F.col("upto") + F.col("n_words")
    drawn = ranked.select("doc_id", "source", "source_no", "block", "n_words", "key", "epochs", "n_blocks", (F.col("rank") + F.col("n_before")).alias("rank"), F.greatest(F.lit(0).cast("long"), F.least("n_words", rest)).alias("more"))
    drawn = durable(drawn.where("epochs > 0 or more > 0"), "drawn")

    passes = F.col("epochs") + (F.col("more") > 0).cast("long")
    quotas = durable(drawn.groupBy("source_no").agg(F.sum(passes).alias("quota")), "quotas")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    levels = max(LEAST_LEVELS, math.ceil(math.log2(max(1.0, total / shard_blocks))))
    # a stretch is met in the cells that it covers, and a block in one, so no block looks through all stretches
    cell_size = F.greatest(F.lit(1), F.ceil(F.col("quota") / (1 << levels))).cast("long")
    cells = quotas.select("source_no", cell_size.alias("cell_size"))  # a row a source
    stretches = split_quotas(quotas, levels, seed).where("first < past").join(F.broadcast(cells), "source_no")
    covered = F.explode(F.sequence(F.floor(F.col("first") / F.col("cell_size")), F.floor((F.col("past") - 1) / F.col("cell_size"))))
    stretches = durable(stretches.select("source_no", "shard", "first", "past", covered.alias("cell")), "stretches")
    if stretches.count() <= BROADCAST_STRETCHES:
        stretches = F.broadcast(stretches)
    each = drawn.join(F.broadcast(cells), "source_no").select("*", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"))
    numbered = each.withColumn("number", F.col("epoch") * F.col("n_blocks") + F.col("rank")).withColumn("cell", F.floor(F.col("number") / F.col("cell_size")))
    met = numbered.join(stretches, ["source_no", "cell"]).where("number >= first and number < past")
    n_words = F.when(F.col("epoch") < F.col("epochs"), F.col("n_words")).otherwise(F.col("more"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.col("source_no"), F.col("number")))
    dealt = met.select("doc_id", "source", "block", "epoch", (F.col("block") * block_words).alias("first_word"), n_words.alias("n_words"), "shard", place.alias("place"), "source_no", "number")
    inside = Window.partitionBy("shard").orderBy("place", "source_no", "number")  # a shard has about shard_blocks rows
    return dealt.withColumn("position", F.row_number().over(inside).cast("long") - 1).drop("place", "source_no", "number"), placed


def mixture_by_document(docs: DataFrame, **options: object) -> DataFrame:
    """One row a document, nothing taken included.

    ``(doc_id, source, size, source_size, target, taken, n_blocks, n_shards, first_shard, first_position)``; the
    last two are those of its block that comes first in the mixture (null where none is taken).
    """
    dealt, placed = mix(docs, **options)  # type: ignore[arg-type]
    by_doc = dealt.groupBy("doc_id", "source").agg(
        F.sum("n_words").alias("taken"), F.count(F.lit(1)).alias("n_blocks"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"), F.min(F.struct("shard", "position")).alias("head")
    )
    p, d = placed.alias("p"), by_doc.alias("d")
    whole = p.join(d, F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("p.source").eqNullSafe(F.col("d.source")), "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(f"d.{c}", zero).alias(c) for c in ("taken", "n_blocks", "n_shards")]
    return whole.select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", *counts, F.col("d.head.shard").alias("first_shard"), F.col("d.head.position").alias("first_position"))


def mixture_texts(docs: DataFrame, **options: object) -> DataFrame:
    """The mixture itself, one row a document that is drawn from.

    ``(doc_id, text, lang, source, size, source_size, target, taken, n_blocks, n_shards, pieces)``: ``text`` has
    the drawn words alone, as often as they are drawn, in the order of ``pieces``: ``(epoch, block, first_word,
    n_words, shard, position)`` of each dealt block. So it has ``taken`` words, and those of a source add up to its
    target. Words keep the white space that follows them.

    Rows that repeat a doc_id and source are one document, their texts in order, with the least ``lang``. Rows
    without a doc_id are documents by their text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.coalesce(id_, F.xxhash64(text)).alias("doc_id"), id_.alias("own_id"), F.col("source").cast("string").alias("source"), text.alias("text"), F.col("lang"))
    dealt, placed = mix(keyed, **options)  # type: ignore[arg-type]
    pieces = F.array_sort(F.collect_list(F.struct("epoch", "block", "first_word", "n_words", "shard", "position")))
    drawn = dealt.groupBy("doc_id", "source").agg(pieces.alias("pieces"))
    texts = keyed.groupBy("doc_id", "source").agg(F.min("own_id").alias("own_id"), F.min("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    same = lambda a, b: (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    both = texts.alias("t").join(drawn.alias("d"), same("t", "d")).join(placed.alias("p"), same("t", "p"))
    words = F.regexp_extract_all(F.concat("t.text", F.lit("\n")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform("d.pieces", lambda x: F.slice(w, (x["first_word"] + 1).cast("int"), x["n_words"].cast("int")))), ""))
    return both.select(
        F.col("t.own_id").alias("doc_id"), F.rtrim(cut, F.lit(" \t\n\x0b\x0c\r")).alias("text"), "t.lang", "t.source", "p.size", "p.source_size", "p.target",
        F.aggregate("d.pieces", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("taken"), F.size("d.pieces").cast("long").alias("n_blocks"), F.size(F.array_distinct("d.pieces.shard")).cast("long").alias("n_shards"), "d.pieces",
    )
