"""Near copies by SimHash: fingerprints, block joins, Hamming check, components.

A document's fingerprint has a bit set where more than half of the hashes of its shingles
have it set. Fingerprints that differ in at most two of 64 bits agree in at least two of
four blocks of 16 bits, so joining on every pair of blocks (six keys) finds every close
pair, and the Hamming distance of each is then checked.

A key that many fingerprints share would make a number of pairs that is quadratic in its
size. Above ``max_bucket`` fingerprints the key is not joined; its members are linked
through their one-bit variants instead. Two fingerprints are within two bits exactly when
they have a fingerprint within one bit of both, and any such meeting point has at most 65
members. Both ways find the same links, so the bound changes the work and not the result.

Defined results: a null text has no words; documents without words have fingerprint zero
and are linked like any other; a text of fewer than three words is one shingle; rows that
repeat an id are separate documents with the same id; a component is named by the smallest
non-null id in it (null if there is none); an empty table gives no rows.

``similar_copies`` is for a similarity on top of the distance. It takes the same steps first: the
block joins, the Hamming check and the components of the fingerprints. An exact check on all
shingles follows, of each text with the first one of its component. But two texts whose shingles agree
to 0.8 (Jaccard) have fingerprints about ten bits apart, where blocks would have to be so
short that nearly all pairs meet. For the pairs beyond two bits further candidates share a band of
``BAND_ROWS`` minimum hashes, of which a text has ``BANDS``: at 0.8 a pair is met with probability 0.997, at 0.9 always
but for 10^-7, while texts that share a line or a fifth of their shingles meet in none. A candidate
is dropped if the fingerprints are further apart than similar texts ever are, and what is left
is decided on all shingles.

In bands whose texts the fingerprints have not connected, a text is compared with the first text of
one of its bands, then, where this leaves some apart, with the first of each. Of what is still apart, small bands are compared pair by pair. Texts in larger bands are
joined by their rarest shingles instead: of two texts similar to s, one of n shingles has one
in common with the other among its n - ceil(s n) + 1 rarest, so this way is exact, and texts
that share a form but not its filling have no rare shingle in common. Texts that share a rare
shingle and are still not similar are told apart without their shingles: of each of ``MARKS`` times 64 bits, a
text has the parity of its shingles' number there. Two texts differ in at least as many shingles
as in bits, so the join itself passes over pairs of too many bits, and never over a similar one. No candidate is
dropped to bound a band.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import connected_components, id_type, record_batch, slim, utf8_rows
from pagetally.session import scratch
from pagetally.sources.tables import materialize

SEED = 42
BITS_APART = 2
# Each choice of two of the four 16-bit blocks, as shifts of the two blocks.
BLOCK_PAIRS = ((0, 16), (0, 32), (0, 48), (16, 32), (16, 48), (32, 48))
MAX_BUCKET = 64
HASHES_AT_ONCE = 1 << 16
BANDS, BAND_ROWS = 32, 8
# Bands of so many texts or fewer are compared pair by pair.
SMALL_BAND = 16
# Fingerprints of similar texts of enough shingles are about 10 bits apart, with a deviation of 3.
FAR_APART, ENOUGH = 26, 32
# Words of parity bits; texts of up to some 600 shingles are told apart down from 0.7.
MARKS = 8
# The minimum hashes of so many shingles at once stay in a core's cache.
SHINGLES_AT_ONCE = 128
SIMILARITY = 0.8


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    # bytes.lower and bytes.split know ASCII letters and white space only.
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1:] - 1).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), HASHES_AT_ONCE):
        spans = zip(starts[i:i + HASHES_AT_ONCE], ends[i:i + HASHES_AT_ONCE], strict=True)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, np.int32)
    bits = np.packbits(ones * 2 > len(starts))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
) -> DataFrame:
    """(id, fp) per row; ``fp`` holds the 64 bits as a signed long."""
    schema = f"id {id_type(docs, id_col)}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([pa.field("id", batch.schema.field("id").type), ("fp", pa.int64())])
            keys, prints = [], []
            for key, text in utf8_rows(batch):
                value = fingerprint(text, shingle_words)
                keys.append(key)
                prints.append(value - (1 << 64) if value >> 63 else value)
            yield record_batch(out, [keys, prints])

    return slim(docs, id_col, text_col).mapInArrow(run, schema)


def close_pairs(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints ``fp`` at most two bits apart.

    Small keys give every close pair; large ones give a star around each meeting point,
    which connects the same fingerprints.
    """
    block = lambda s: F.shiftrightunsigned("fp", s).bitwiseAND(0xFFFF)
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(block(a), 16) + block(b)
        for n, (a, b) in enumerate(BLOCK_PAIRS)
    ]
    blocks = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(blocks.join(sizes, "key"), "blocks")
    few = shared.where(F.col("n") <= max_bucket).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .where(F.col("u") < F.col("v"))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS_APART)
        .select("u", "v")
    )
    many = shared.where(F.col("n") > max_bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[
        F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    stars = (
        many.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
        .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
        .where("u <> v")
    )
    return pairs.union(stars).distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = 3, max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    found = connected_components(close_pairs(classes.select("fp"), max_bucket))
    joined = found.join(classes.withColumnRenamed("fp", "node"), "node")
    names = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(names, "component").select(F.col("node").alias("fp"), "component_id")
    # Written out, so that the last join is a plain one whose large partitions can be split.
    per_class = materialize(classes.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return prints.join(per_class, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingle_hashes(text: bytes | None, shingle_words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, as sorted signed longs."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1:] - 1).tolist()
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)).view(np.int64))


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms, one of each for a minimum hash."""
    rng = np.random.default_rng(SEED)
    n = BANDS * BAND_ROWS
    return tuple(rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(odd) for odd in (1, 0))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a text's bands; the number of the band is part of its key."""
    factors, terms = _permutations()
    least = np.full(len(factors), (1 << 64) - 1, np.uint64)
    values = hashes.view(np.uint64)
    for i in range(0, len(values), SHINGLES_AT_ONCE):
        least = np.minimum(least, (values[i:i + SHINGLES_AT_ONCE, None] * factors + terms).min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(rows)], np.uint64).view(np.int64)


def _signatures(rows: DataFrame, shingle_words: int) -> DataFrame:
    """(row, digest, n, fp, bands): digest of the distinct shingles, their number, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("row", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("fp", pa.int64()),
                         ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            columns = [[], [], [], [], []]
            for key, text in utf8_rows(batch):
                hashes = shingle_hashes(text, shingle_words)
                ones = np.zeros(64, np.int64)
                for i in range(0, len(hashes), HASHES_AT_ONCE):
                    part = hashes[i:i + HASHES_AT_ONCE].astype(">i8")
                    ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, np.int32)
                bits = np.packbits(ones * 2 > len(hashes)).tobytes()
                found = (key, xxhash.xxh3_128_hexdigest(hashes.tobytes()), len(hashes),
                         int.from_bytes(bits, "big", signed=True), bands(hashes) if len(hashes) else [])
                for column, value in zip(columns, found, strict=True):
                    column.append(value)
            yield record_batch(out, columns)

    return rows.mapInArrow(run, "row long, digest string, n long, fp long, bands array<long>")


def _all_shingles(rows: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hashes) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])
        for batch in batches:
            for key, text in utf8_rows(batch):
                yield record_batch(out, [[key], [shingle_hashes(text, shingle_words)]])

    return rows.mapInArrow(run, "node long, hashes array<long>")


def _alike(
    pairs: DataFrame, rows: DataFrame, shingle_words: int, similarity: float, many: bool = False,
) -> DataFrame:
    """Those of the distinct pairs (u, v) of rows whose shingles are similar, as a written table.

    ``many`` plans for pairs that hold too large a part of the rows to be broadcast, whatever the size.
    """
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    nodes = nodes.hint("merge") if many else nodes
    texts = rows.join(nodes, rows["id"] == nodes["u"], "left_semi").select("id", "text")
    sets = materialize(_all_shingles(texts, shingle_words), "shingles")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_u", "of_v"))
    union = F.size("of_u") + F.size("of_v") - both
    found = pairs.join(of("u"), "u").join(of("v"), "v").where(both >= similarity * union - 1e-9)
    return materialize(found.select("u", "v"), "alike")


def _possible(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (u, v) of structs (node, n, fp) that may be similar by size, fingerprint and marks, if they have any."""
    sized = met.where(F.least("u.n", "v.n") >= F.lit(similarity) * F.greatest("u.n", "v.n") - 1e-9)
    apart = F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp")))
    near = sized.where((F.least("u.n", "v.n") < ENOUGH) | (apart <= FAR_APART))
    if "marks" in met.schema["u"].dataType.names:
        differ = sum(F.bit_count(F.col(f"u.marks.p{w}").bitwiseXOR(F.col(f"v.marks.p{w}"))) for w in range(MARKS))
        most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("u.n") + F.col("v.n"))
        near = near.where(differ <= most + 1e-9)
    low, high = F.least("u.node", "v.node"), F.greatest("u.node", "v.node")
    return materialize(near.select(low.alias("u"), high.alias("v")).where("u < v").distinct(), "pairs")


def _labelled(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (key, of) of keys that still hold texts of several components, with ``label``."""
    names = connected_components(links)
    named = materialize(keys.join(names, keys["of.node"] == names["node"], "left").select(
        "key", "of", F.coalesce("component", "of.node").alias("label")), "labelled")
    open_keys = named.groupBy("key").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("members")).where("a < b")
    return materialize(named.join(open_keys.select("key", "members"), "key"), "open")


def _pairs_within(keys: DataFrame) -> DataFrame:
    """Pairs of texts of different components that share a key."""
    side = lambda c: keys.select("key", F.col("of").alias(c), F.col("label").alias(f"of_{c}"))
    return side("u").join(side("v"), "key").where("u.node < v.node AND of_u <> of_v").select("u", "v")


def _shared_bands(classes: DataFrame) -> DataFrame:
    """(key, of) of the bands that more than one text has.

    Most bands have one text only, so they are counted and dropped as two numbers each.
    """
    narrow = classes.where("n > 0").select(F.explode("bands").alias("key"), "node")
    often = narrow.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    shared = materialize(narrow.join(often, "key", "left_semi"), "shared")
    of = classes.select(F.struct("node", "n", "fp").alias("of"))
    return materialize(shared.join(of, shared["node"] == of["of.node"]).select("key", "of"), "bands")


def _with_first(keys: DataFrame) -> DataFrame:
    """Pairs of each text with the first one of a key."""
    firsts = keys.groupBy("key").agg(F.min("of").alias("u"), F.count("*").alias("members")).where("members > 1")
    return keys.withColumnRenamed("of", "v").join(firsts, "key").where("u.node <> v.node").select("u", "v")


def _with_one(keys: DataFrame) -> DataFrame:
    """Pairs of each text with one other: the smallest of the first ones of its keys."""
    return _with_first(keys).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")


def _close_copies(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of each text with the first one that close fingerprints lead to."""
    prints = classes.groupBy("fp").agg(F.min(F.struct("node", "n", "fp")).alias("first"))
    prints = materialize(prints, "prints")
    ends = materialize(connected_components(close_pairs(prints.select("fp"))), "close")
    named = prints.join(ends, prints["fp"] == ends["node"], "left").select(
        prints["fp"], "first", F.coalesce("component", prints["fp"]).alias("component"))
    heads = named.groupBy("component").agg(F.min("first").alias("u"))
    heads = materialize(named.join(heads, "component").select(F.col("fp").alias("of_fp"), "u"), "heads")
    of = classes.select(F.struct("node", "n", "fp").alias("v"))
    return of.join(heads, F.col("v.fp") == F.col("of_fp")).where("u.node <> v.node").select("u", "v")


def _rare_keys(texts: DataFrame, classes: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(key, of): the rarest shingles of each text, of which similar texts share one; ``of`` has its marks, too.

    Shingles are counted over the texts given and those of one text only are left out.
    """
    hashes = _all_shingles(texts, shingle_words).select("node", F.explode("hashes").alias("key"))
    hashes = materialize(hashes, "exploded")
    counts = materialize(hashes.groupBy("key").agg(F.count("*").alias("times")), "times")
    order = Window.partitionBy("node").orderBy("times", "key")
    of_node = Window.partitionBy("node")
    ranked = hashes.join(counts, "key").select(
        "node", "key", "times", F.row_number().over(order).alias("place"), F.count("*").over(of_node).alias("all"))
    needed = F.col("all") - F.ceil(F.lit(similarity) * F.col("all") - 1e-9) + 1
    rare = ranked.where((F.col("place") <= needed) & (F.col("times") > 1)).select("key", "node")
    bit = "shiftleft(1L, CAST(key & 63 AS INT))"
    marks = materialize(hashes.groupBy("node").agg(*[
        F.expr(f"bit_xor(CASE WHEN shiftrightunsigned(key, 6) % {MARKS} = {w} THEN {bit} ELSE 0L END)").alias(f"p{w}")
        for w in range(MARKS)]), "marks")
    of = classes.join(marks, "node").select(
        F.struct("node", "n", "fp", F.struct(*[f"p{w}" for w in range(MARKS)]).alias("marks")).alias("of"))
    return materialize(rare.join(of, rare["node"] == of["of.node"]).select("key", "of"), "rare")


def similar_links(
    classes: DataFrame, rows: DataFrame, shingle_words: int, similarity: float, small_band: int = SMALL_BAND,
) -> tuple[DataFrame, list[DataFrame]]:
    """Links (u, v) that connect similar texts of ``classes`` (node, n, fp, bands), and the
    tables of pairs that were decided on all their shingles."""
    decided: list[DataFrame] = []

    def decide(met: DataFrame, many: bool = False) -> DataFrame:
        decided.append(_possible(met, similarity))
        return _alike(decided[-1], rows, shingle_words, similarity, many)

    close = materialize(_close_copies(classes), "close_copies")
    keys = _shared_bands(classes)
    # What the fingerprints connect needs no band; one more text is tried for the others.
    unmet = _labelled(keys, close.select("u.node", "v.node").toDF("u", "v")).select("key", "of")
    links = decide(close.union(_with_one(unmet)), many=True)
    apart = _labelled(keys, links)
    links = links.union(decide(_with_first(apart.select("key", "of"))))
    apart = _labelled(apart.select("key", "of"), links)
    links = links.union(decide(_pairs_within(apart.where(F.col("members") <= small_band))))
    large = apart.where(F.col("members") > small_band).select("of").distinct()
    if not large.isEmpty():
        texts = rows.join(large, rows["id"] == large["of.node"], "left_semi")
        rare = _rare_keys(texts, classes, shingle_words, similarity)
        links = links.union(decide(_with_one(rare)))
        rare = _labelled(rare, links).select("key", "of")
        links = links.union(decide(_with_first(rare)))
        links = links.union(decide(_pairs_within(_labelled(rare, links))))
    return links, decided


def similar_copies(
    docs: DataFrame, row_col: str, text_col: str = "text",
    shingle_words: int = 5, similarity: float = SIMILARITY,
) -> DataFrame:
    """(row, component) per row of ``docs``: the smallest row that similar texts lead to.

    ``row_col`` is a long that is unique and stays the same when ``docs`` is read again. Texts
    without words are alike. A similarity below ``SIMILARITY`` would need more bands.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"similarity below {SIMILARITY}")
    rows = slim(docs, row_col, text_col)
    with scratch(docs.sparkSession) as outside:
        found = materialize(_signatures(rows, shingle_words), "signatures")
        classes = materialize(found.groupBy("digest").agg(
            F.min("row").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"),
            F.first("bands").alias("bands")), "classes")
        links, _ = similar_links(classes, rows, shingle_words, similarity)
        ends = connected_components(links)
        of_class = materialize(classes.join(ends, "node", "left").select(
            "digest", F.coalesce("component", "node").alias("component")), "ends")
        with outside():
            return materialize(found.join(of_class, "digest").select(F.col("row").alias(row_col), "component"), "copies")
