"""Benchmark decontamination by winnowing, with built-in functions only.

Texts become words; every ``GRAM`` consecutive words get a hash, and in each window of
consecutive grams that spans ``WINDOW_WORDS`` words the smallest hash is kept. A span of
``WINDOW_WORDS`` words that a document shares with a benchmark item has the same grams
in both, so the same smallest one: joining the kept hashes finds every shared span. Each
meeting is then extended word by word to both sides, on the words themselves.
An item shorter than a window is one window: all its words are one gram, for which the
documents' grams of that length are all kept.

The joined hashes of a document are first looked up in a bit set of fixed size
(``FILTER_BITS``) filled from the benchmark. It only saves work: what passes it is joined,
whatever the size of the benchmark.

Defined results: a null or empty text has no words; an item without words has no windows;
items without an id mark words but are not counted; repeated item ids count once; every
row of a repeated document id is judged for itself; without documents there are no rows, and
without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import slim
from pagetally.sources.tables import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW_WORDS = 13
GRAM = 7
GRAMS_IN_WINDOW = WINDOW_WORDS - GRAM + 1
SIDE = WINDOW_WORDS - GRAM
FILTER_BITS = 1 << 18
# A document is contaminated if at least this part of its words is hit.
CONTAMINATED_PART = 20


def words_of(text: Column) -> Column:
    """Words of a text with A to Z, and no other letters, in lower case."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _span(df: DataFrame, source: str, width: int, join, prefix: str) -> tuple[DataFrame, str]:
    """A column that combines ``width`` neighbours of ``source``, by doubling.

    Values near the end, where there are too few neighbours, are meaningless.
    """
    done, name = 1, source
    while done < width:
        step = min(done, width - done)
        new = f"{prefix}{done + step}"
        ahead = F.slice(F.col(name), F.lit(step + 1), F.greatest(F.size(name) - step, F.lit(0)))
        df = df.withColumn(new, F.zip_with(F.col(name), ahead, join))
        done, name = done + step, new
    return df, name


def _head(column: str, size: Column) -> Column:
    return F.slice(F.col(column), F.lit(1), F.greatest(size, F.lit(0)))


def _kept_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``grams`` and ``kept`` for windows, and the same per length of short items."""
    hashed = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    out, gram = _span(hashed, "h1", GRAM, lambda x, y: F.xxhash64(x, y), "h")
    out = out.withColumn("grams", _head(gram, F.size("words") - GRAM + 1))
    out, least = _span(out, "grams", GRAMS_IN_WINDOW, lambda x, y: F.least(x, y), "m")
    out = out.withColumn("kept", F.array_distinct(_head(least, F.size("words") - WINDOW_WORDS + 1)))
    for n in lengths:
        out, gram = _span(out, "h1", n, lambda x, y: F.xxhash64(x, y), f"s{n}_")
        salted = F.transform(_head(gram, F.size("words") - n + 1), lambda g: F.xxhash64(F.lit(n), g))
        out = out.withColumn(f"grams_{n}", salted)
        out = out.withColumn(f"kept_{n}", F.array_distinct(f"grams_{n}"))
    return out


def _seeds(grams: str, chosen: Column, gram: int, side: int, need: int) -> Column:
    """Places of the chosen grams with the words around them."""
    placed = F.transform(F.col(grams), lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    found = F.filter(placed, lambda s: F.array_contains(chosen, s["gram"]))

    def seed(s: Column) -> Column:
        left = F.least(s["at"], F.lit(side))
        return F.struct(
            s["gram"].alias("gram"), F.lit(need).alias("need"), F.lit(gram).alias("width"),
            s["at"].alias("at"), left.alias("left"),
            F.slice(F.col("words"), s["at"] - left + 1, left + gram + side).alias("around"))

    empty = F.array().cast(
        "array<struct<gram:bigint,need:int,width:int,at:int,left:int,around:array<string>>>")
    return F.when(F.size(chosen) > 0, F.transform(found, seed)).otherwise(empty)


def _bit(gram: Column, turn: int) -> Column:
    return F.shiftrightunsigned(gram, turn).bitwiseAND(FILTER_BITS - 1)


TURNS = (0, 24)


def _filter_words(grams: DataFrame) -> DataFrame:
    """One row: the bit set as 64-bit words, at most FILTER_BITS / 64 of them."""
    bits = grams.select(F.explode(F.array(*[_bit(F.col("gram"), t) for t in TURNS])).alias("bit"))
    filled = bits.groupBy(F.shiftright("bit", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    every = grams.sparkSession.range(0, FILTER_BITS // 64, 1, 1).join(filled, "id", "left")
    pairs = every.agg(F.sort_array(F.collect_list(
        F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("pairs"))
    return pairs.select(F.transform("pairs", lambda p: p["word"]).alias("bits"))


def hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Documents as (row, id, n_words), and their hit spans as (row, item, start, end).

    ``row`` tells rows of the same id apart. Both tables are written to the shared folder.
    """
    words = slim(benchmark, item_col, item_text_col).select("id", words_of(F.col("text")).alias("words"))
    words = materialize(words.where(F.size("words") > 0), "items")
    sizes = words.where(F.size("words") < WINDOW_WORDS).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r.n for r in sizes.collect())  # fewer than WINDOW_WORDS numbers

    known = _kept_grams(words, lengths)
    long_ones = F.when(F.size("words") >= WINDOW_WORDS, _seeds("grams", F.col("kept"), GRAM, SIDE, WINDOW_WORDS))
    own = [long_ones] + [
        F.when(F.size("words") == n, _seeds(f"grams_{n}", F.col(f"kept_{n}"), n, 0, n)) for n in lengths]
    items = materialize(
        known.select("id", F.explode(F.coalesce(*own)).alias("s")).select(F.col("id").alias("item"), "s.*"),
        "item-grams")
    bits = _filter_words(items.select("gram").distinct()).scalar()

    def maybe(kept: str) -> Column:
        def known_bit(g: Column, turn: int) -> Column:
            bit = _bit(g, turn)
            word = F.get("bits", F.shiftright(bit, 6).cast("int"))
            inside = bit.bitwiseAND(63).cast("int")
            return F.call_function("shiftright", word, inside).bitwiseAND(1) == 1

        return F.filter(F.col(kept), lambda g: known_bit(g, TURNS[0]) & known_bit(g, TURNS[1]))

    scanned = slim(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "id", words_of(F.col("text")).alias("words"))
    # As a column, because functions over arrays take no subqueries.
    scanned = _kept_grams(scanned, lengths).withColumn("bits", bits)
    scanned = scanned.withColumn("chosen", maybe("kept"))
    for n in lengths:
        scanned = scanned.withColumn(f"chosen_{n}", maybe(f"kept_{n}"))
    scanned = scanned.drop("bits")
    seeds = [_seeds("grams", F.col("chosen"), GRAM, SIDE, WINDOW_WORDS)] + [
        _seeds(f"grams_{n}", F.col(f"chosen_{n}"), n, 0, n) for n in lengths]
    scanned = materialize(scanned.select(
        "row", "id", F.size("words").cast("long").alias("n_words"),
        (F.concat(*seeds) if len(seeds) > 1 else seeds[0]).alias("seeds")), "seeds")

    a = scanned.where(F.size("seeds") > 0).select("row", F.explode("seeds").alias("s")).select("row", "s.*")
    b = items.select("gram", "need", "item", F.col("left").alias("i_left"), F.col("around").alias("i_around"))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))

    def run(x: Column, y: Column) -> Column:
        """How many words two lists have in common from their start."""
        equal = F.zip_with(x, y, same)
        wrong = F.array_position(equal, F.lit(False))
        return F.when(wrong == 0, F.size(equal)).otherwise(wrong - 1).cast("int")

    before = lambda words, n: F.reverse(F.slice(F.col(words), F.lit(1), F.col(n)))
    after = lambda words, n: F.slice(F.col(words), F.col(n) + F.col("width") + 1, F.lit(SIDE))
    core = lambda words, n: F.slice(F.col(words), F.col(n) + 1, F.col("width"))
    found = (
        a.join(b, ["gram", "need"])
        .where(core("around", "left") == core("i_around", "i_left"))
        .withColumn("back", run(before("around", "left"), before("i_around", "i_left")))
        .withColumn("on", run(after("around", "left"), after("i_around", "i_left")))
        .where(F.col("back") + F.col("width") + F.col("on") >= F.col("need"))
        .select("row", "item", (F.col("at") - F.col("back")).alias("start"),
                (F.col("at") + F.col("width") + F.col("on")).alias("end"))
        .distinct()
    )
    return scanned.select("row", "id", "n_words"), materialize(found, "hits")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(row, id, n_words, n_hit, items, contaminated) per row of ``docs``.

    ``items`` holds the ids, as sorted strings, of the items with a window in the row.
    """
    scanned, found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    places = (found.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
              .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    items = (found.where("item IS NOT NULL").select("row", F.col("item").cast("string").alias("item"))
             .distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scanned.join(places, "row", "left").join(items, "row", "left").select(
        "row", F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * CONTAMINATED_PART >= F.col("n_words"))).alias("contaminated"))
