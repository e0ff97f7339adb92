"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are brought to one form in which numbers, names and units are typed placeholders.
Windows of K tokens of that form are hash-joined, so a question is found even where its numbers or names were
changed; then the values that stand in an item's slots must be replaced consistently, each by one value
throughout, for the find to count. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable
from loomspark.llm.sqlblocks import let, runs

#: Tokens of a window, the largest step between diagonals of one find, and the share of an item that must be covered.
K, MERGE, COVER = 5, 3, 0.8
#: Benchmark windows up to so many are broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: A template needs at least so many tokens that are not placeholders, and has at most so many tokens to get them.
LITERALS, MOST_TOKENS = 2, 64
#: Documents with likely finds up to so many are broadcast to pick their texts.
BROADCAST_IDS = 500_000

# Number words and units of measure.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "g", "kg", "gram", "grams", "pound", "pounds", "ounce", "ounces", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh",
]

_FIRST = "§"  # marks the first word of a sentence, where a capital says nothing


def _spaced(text: Column) -> Column:
    """Letters-and-digits words of a text as they stand, one space between; the first of each sentence carries a mark.

    Digits joined by a point or comma are one number.
    """
    plain = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_FIRST), F.lit(" "))
    joined = F.regexp_replace(plain, r"(?<=[0-9])[.,](?=[0-9])", "")
    marked = F.regexp_replace(joined, r"(?:^|[.!?]\s|\n)[^\p{L}\p{N}]*(?=[\p{L}\p{N}])", f" {_FIRST}")
    return F.trim(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{_FIRST}]+", " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def canonical(spaced: Column) -> Column:
    """The words in lower case, with ``<num>``, ``<unit>`` and ``<name>`` (a capital inside a sentence) for values."""

    def one(raw: Column, word: Column) -> Column:
        head, own = F.substring(word, 1, 1), F.substring(raw, 1, 1)
        return F.when(((head >= "0") & (head <= "9")) | word.isin(NUMBER_WORDS), F.lit("<num>")).when(word.isin(UNITS), F.lit("<unit>")).when((own != head) & (own != _FIRST), F.lit("<name>")).otherwise(word)

    return let(spaced, lambda s: F.zip_with(_words(s), _words(F.lower(F.replace(s, F.lit(_FIRST), F.lit("")))), one))


def _slot(token: Column) -> Column:
    return token.isin("<num>", "<unit>", "<name>")


def lengths_of(k: int, most: int = MOST_TOKENS) -> list[int]:
    """The lengths that windows may have: k, and from there each half as long again."""
    found = [k]
    while found[-1] + max(2, found[-1] // 2) <= most:
        found.append(found[-1] + max(2, found[-1] // 2))
    return found


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(items: DataFrame, k: int) -> DataFrame:
    """``(item_id, item_size, t, n, hash, by_words)``: the windows that an item is looked for by, n tokens from t."""
    whole = items.where((F.col("item_size") > 0) & (F.col("item_size") < k)).select("item_id", "item_size", F.lit(0).alias("t"), F.col("item_size").alias("n"), F.get(runs(_hashed(F.col("item_words")), F.col("item_size")), F.lit(0)).alias("hash"), F.lit(True).alias("by_words"))
    placed = items.where(F.col("item_size") >= k).select("*", F.explode(F.sequence(F.lit(0), F.col("item_size") - k)).alias("t"))
    literals = lambda at, n: F.size(F.filter(F.slice("item_tokens", at + 1, n), lambda w: ~_slot(w)))
    at = lambda n: F.least(F.col("t"), F.col("item_size") - n)
    grown = [F.when((F.col("item_size") >= n) & (literals(F.greatest(at(n), F.lit(0)), F.lit(n)) >= LITERALS), F.struct(at(n).alias("t"), F.lit(n).alias("n"))) for n in lengths_of(k)]
    template = placed.withColumn("w", F.coalesce(*grown)).where("w is not null")
    hashed = lambda tokens, at, n: F.xxhash64(F.slice(_hashed(F.col(tokens)), at + 1, n))
    by_template = template.select("item_id", "item_size", "w.t", "w.n", hashed("item_tokens", F.col("w.t"), F.col("w.n")).alias("hash"), F.lit(False).alias("by_words"))
    by_words = placed.select("item_id", "item_size", "t", F.lit(k).alias("n"), hashed("item_words", F.col("t"), F.lit(k)).alias("hash"), F.lit(True).alias("by_words"))
    return by_template.distinct().union(by_words).union(whole)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, cover: float = COVER) -> DataFrame:
    """One row for each benchmark item found in a document: ``(doc_id, item_id, first_token, n_windows, coverage, n_slots, n_changed)``.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns are left
    alone. ``coverage`` is the share of the item's tokens under windows found along neighbouring diagonals,
    at least ``cover``; of several finds in one document the best covered is reported. ``n_slots`` counts the
    different values in the item's slots under them and ``n_changed`` those that the document replaces; a
    value that stands for two different ones makes the find void. Each token of the item is held against one
    word of the document, that of the diagonal with most equal words; a diagonal that covers enough by
    itself is also judged alone.

    A window is looked for twice: by its template, and by its words in lower case, values included, so that
    letter case, which tells names from other words, hides no copy. A template with fewer than LITERALS tokens
    that are not placeholders grows, by the lengths of ``lengths_of``, until it has them; what can't is looked for
    by its words alone, as are items of fewer than k tokens as a whole. An item of one word is thus found in every
    document with that word: leave such items out. A name that begins a sentence is no slot.

    Null and empty texts hold nothing; null ids are dropped. Repeated documents give the same rows once for
    each doc_id; items with equal texts are each reported. An empty table on either side gives none.
    """
    text = F.col("text").cast("string")
    bare = lambda spaced: _words(F.lower(F.replace(spaced, F.lit(_FIRST), F.lit(""))))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _spaced(text).alias("spaced")).where("item_id is not null").distinct()
    items = items.select("item_id", bare(F.col("spaced")).alias("item_words"), canonical(F.col("spaced")).alias("item_tokens")).withColumn("item_size", F.size("item_tokens"))
    pieces = _windows(items, k)
    asked = {(row["by_words"], row["n"]) for row in pieces.select("by_words", "n").distinct().collect()}  # a row a length
    longer = sorted(n for by_words, n in asked if not by_words and n > k)
    shorter = sorted(n for by_words, n in asked if by_words and n < k)
    pieces = pieces.drop("by_words").distinct()
    if pieces.count() <= BROADCAST_WINDOWS:
        pieces = F.broadcast(pieces)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id is not null")

    def hashes(spaced: Column) -> Column:
        def of(tokens: Column, words: Column) -> Column:
            # by words only where that differs from the template
            both = let(runs(tokens, k), lambda t: F.array(t, F.zip_with(runs(words, k), t, lambda a, b: F.when(a != b, a))))
            more = [runs(tokens, n) for n in longer] + [runs(words, n) for n in shorter]
            return F.concat(both, F.array(*more)) if more else both

        return let(_hashed(canonical(spaced)), lambda tokens: let(_hashed(bare(spaced)), lambda words: of(tokens, words)))

    each = keyed.select("doc_id", "th", F.explode(let(_spaced(F.col("text")), hashes)).alias("hashes"))
    hits = each.select("doc_id", "th", F.posexplode("hashes").alias("d", "hash")).where("hash is not null").join(pieces, "hash")
    key = ["doc_id", "th", "item_id"]
    diagonals = hits.groupBy(*key, "item_size", (F.col("d") - F.col("t")).alias("diagonal")).agg(F.array_sort(F.collect_set(F.struct("t", "n"))).alias("ts"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > MERGE).cast("int")
    merged = diagonals.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn("cluster", F.sum("starts").over(order))
    finds = merged.groupBy(*key, "item_size", "cluster").agg(F.collect_list(F.struct("diagonal", "ts")).alias("diagonals"))
    under = lambda ts: F.array_distinct(F.flatten(F.transform(ts, lambda x: F.sequence(x["t"], x["t"] + x["n"] - 1))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("diagonals", lambda g: under(g["ts"])))))
    likely = durable(finds.where(covered / F.col("item_size") >= cover).drop("item_size").join(items.hint("merge"), "item_id"), "finds")

    # the values are looked up in the texts of the documents with likely finds: of each diagonal, its stretch of words
    ids = durable(likely.select("doc_id", "th").distinct(), "ids")
    wanted = keyed.join(F.broadcast(ids), ["doc_id", "th"], "left_semi") if ids.count() <= BROADCAST_IDS else keyed
    asked_for = likely.join(wanted.hint("merge"), ["doc_id", "th"])

    def stretch(words: Column) -> Column:
        low = lambda g: F.element_at(g["ts"], 1)["t"]
        high = lambda g: F.array_max(F.transform(g["ts"], lambda x: x["t"] + x["n"]))
        cut = lambda g: F.slice(words, g["diagonal"] + low(g) + 1, high(g) - low(g))
        return F.transform("diagonals", lambda g: F.struct(g["diagonal"].alias("diagonal"), g["ts"].alias("ts"), cut(g).alias("words")))

    alone = F.size("diagonals") == 1
    along = asked_for.select(*key, "cluster", "item_size", "item_words", "item_tokens", alone.alias("alone"), F.explode(let(let(_spaced(F.col("text")), bare), stretch)).alias("g"))
    pair = lambda x: F.struct(x.alias("x"), F.get("item_tokens", x).alias("kind"), F.get("item_words", x).alias("a"), F.get("g.words", x - F.element_at("g.ts", 1)["t"]).alias("b"))
    paired = along.withColumn("pairs", F.transform(under(F.col("g.ts")), pair)).withColumn("n_equal", F.size(F.filter("pairs", lambda p: p["a"] == p["b"])))

    # an alignment is one diagonal, or (null) all of the cluster
    one, every = F.array("g.diagonal"), F.array(F.col("g.diagonal"), F.lit(None).cast("int"))
    tokens = paired.select(*key, "cluster", "item_size", "n_equal", "g.diagonal", F.size("g.ts").alias("n"), "pairs", F.explode(F.when(F.col("alone"), one).otherwise(every)).alias("alignment")).select("*", F.explode("pairs").alias("p"))
    held = F.struct("p.kind", "p.a", "p.b", "diagonal", "n", (F.col("diagonal") + F.col("p.x")).alias("place"))
    aligned = tokens.groupBy(*key, "item_size", "cluster", "alignment", "p.x").agg(F.max_by(held, F.struct("n_equal", -F.col("diagonal"))).alias("h"))
    slot = _slot(F.col("h.kind"))
    judged = aligned.groupBy(*key, "item_size", "cluster", "alignment").agg(
        (F.count(F.lit(1)) / F.first("item_size")).alias("coverage"), F.collect_set(F.struct("h.diagonal", "h.n")).alias("used"), F.min("h.place").alias("first"),
        F.collect_set(F.when(slot, F.struct("h.kind", "h.a", "h.b"))).alias("slots"), F.collect_set(F.when(slot, F.struct("h.kind", "h.a"))).alias("values"),
    )
    sure = judged.where((F.col("coverage") >= cover) & (F.size("slots") == F.size("values")))
    n_windows = F.aggregate("used", F.lit(0), lambda a, g: a + g["n"])
    out = F.struct("coverage", n_windows.alias("n_windows"), (-F.col("first")).alias("place"), F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda p: p["a"] != p["b"])).alias("n_changed"))
    best = sure.groupBy("doc_id", "item_id").agg(F.max(out).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.place")).cast("long").alias("first_token"), F.col("x.n_windows").cast("long").alias("n_windows"), "x.coverage", F.col("x.n_slots").cast("long").alias("n_slots"), F.col("x.n_changed").cast("long").alias("n_changed"))
