"""Ranked entity search, and substring search through a trigram index."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetra.functions.text import coordinates, despaced, parse_citation
from facetra.operators.lookup import MODERN_ID, OLD_ID
from facetra.storage import stored

# What runs in tasks travels by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents in a block of the block index.
BLOCK = 4096
#: Documents whose grams share a bit of a bitmap, and grams of a query whose bitmaps are and-ed.
DOCS_A_BLOCK = 8
USED = 8
#: Signs of a query's beginning that are anchored, and of an anchor. Shorter queries are compared with each candidate.
BEGIN, ANCHOR = 24, 16
#: Bitmaps that are handed on at once, and their bytes.
PIECE, BYTES = 2048, 4096


def leads(queries: DataFrame) -> DataFrame:
    """q, kind, name: what a query names outright, a record's id or a cited page; these come before all entities."""
    q = F.trim("q")
    cited = parse_citation(F.col("q"))
    hit = lambda kind, order, name: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("lead"), name.alias("name"))
    found = F.array(
        F.when(q.rlike(f"{MODERN_ID}|{OLD_ID}"), hit("document", 0, q)),
        F.when(cited.isNotNull(), hit("citation", 1, coordinates(cited["volume"], cited["part"], cited["page"]))),
    )
    return queries.select("q").distinct().select("q", F.inline(F.array_compact(found)))


def entities(queries: DataFrame, dims: DataFrame, per_kind: int = 4, k: int = 8) -> DataFrame:
    """q, kind, name, n, rank: what the query names outright, then names that hold it, white space ignored; beginnings first,
    then by kind and size.

    dims: (kind, kind_order, name, n), a table of entities. Names are posted under their substrings of one to three signs, a
    query looks up the rarest of its substrings of three signs (or itself, if it is shorter), and what is posted there is
    compared with it: queries and names meet by equality.
    """
    lead = leads(queries)
    asked = queries.select("q").distinct().withColumn("_q", despaced(F.col("q"))).where("_q <> ''")
    hay, needle = F.col("_name"), F.col("_q")
    names = dims.withColumn("_name", despaced(F.col("name")))
    posted = names.select("*", F.explode(F.array_distinct(F.flatten(F.array(*[grams(hay, n) for n in (1, 2, 3)])))).alias("_gram"))
    own = F.when(F.length(needle) < 3, F.array(needle)).otherwise(grams(needle))
    df = posted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    tried = asked.select("q", "_q", F.explode(own).alias("_gram")).join(df, "_gram", "left")
    rarest = tried.groupBy("q", "_q").agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    found = rarest.join(posted, "_gram").where(hay.contains(needle))
    order = [F.when(hay.startswith(needle), 0).otherwise(1), "kind_order", F.desc("n"), "name"]
    place = lambda *keys, by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    one = found.withColumn("_k", place("q", "kind", by=order)).where(F.col("_k") <= per_kind)
    rest = one.select("q", F.lit(2).alias("lead"), place("q", by=order).alias("at"), "kind", "name", "n")
    first = lead.select("q", "lead", F.lit(0).alias("at"), "kind", "name", F.lit(None).cast(dims.schema["n"].dataType).alias("n"))
    return first.unionByName(rest).withColumn("rank", place("q", by=["lead", "at"])).where(F.col("rank") <= k).select("q", "kind", "name", "n", "rank")


def grams(text: Column, n: int = 3) -> Column:
    """The distinct substrings of n signs of a text, found in one pass: a look-ahead at every place, which
    then takes one sign, so that none begins within a surrogate pair."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1))), F.array().cast("array<string>"))


def trigram_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """gram, doc_id: the postings, one row each, so that a frequent gram is spread over tasks."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(grams(F.col(text))).alias("gram"))


def gram_stats(index: DataFrame, drop_df: int = 2) -> DataFrame:
    """gram, df of the grams that stay in the dictionary (df over ``drop_df``)."""
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > drop_df)


def block_index(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """gram, block, df: how many documents of each block hold a gram."""
    return index.groupBy("gram", F.expr(f"doc_id DIV {block}").alias("block")).agg(F.count(F.lit(1)).alias("df"))


def bitmap_index(index: DataFrame, block: int = DOCS_A_BLOCK) -> DataFrame:
    """gram, bucket, blocks: for each gram the blocks of ``block`` documents that hold it, as bitmaps of 32,768 blocks. Ids are
    places in a dense order (``ordered.numbered`` gives such), from 0."""
    no = F.expr(f"doc_id DIV {block} + 1")
    return index.groupBy("gram", F.bitmap_bucket_number(no).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(no)).alias("blocks"))


def document_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_df: int = 2) -> DataFrame:
    """``gram_stats`` of documents without their postings: tasks count the texts that they read, and Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(_codes, batch.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signs(codes), pa.array(n, pa.int64())], ["gram", "n"])

    rows = docs.select(F.col(text).alias("text")).where(F.length("text") >= 3).mapInArrow(run, "gram string, n long")
    return rows.groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") > drop_df)


def document_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = DOCS_A_BLOCK) -> DataFrame:
    """``bitmap_index`` of documents without their postings: tasks give a bitmap a gram of the texts in a batch, and Spark ors
    them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = list(map(_codes, batch.column(2).to_pylist()))
            for bucket in np.unique(buckets):
                some = np.flatnonzero(buckets == bucket)
                grams_, row = np.unique(np.concatenate([own[i] for i in some]), return_inverse=True)
                at = np.repeat(places[some], [len(own[i]) for i in some])
                order = np.argsort(row, kind="stable")
                row, at, signs = row[order], at[order], _signs(grams_)
                for start in range(0, len(grams_), PIECE):
                    lo, hi = np.searchsorted(row, [start, start + PIECE])
                    bits = np.zeros((min(PIECE, len(grams_) - start), BYTES), np.uint8)
                    np.bitwise_or.at(bits, (row[lo:hi] - start, at[lo:hi] >> 3), (1 << (at[lo:hi] & 7)).astype(np.uint8))
                    blocks = pa.array(list(map(bytes, bits)), pa.binary())
                    yield pa.RecordBatch.from_arrays([signs.slice(start, len(bits)), pa.array(np.full(len(bits), bucket)), blocks], ["gram", "bucket", "blocks"])

    no = F.expr(f"`{doc_id}` DIV {block} + 1")
    rows = docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= 3)).select(F.bitmap_bucket_number(no).alias("bucket"), F.bitmap_bit_position(no).alias("at"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "gram string, bucket long, blocks binary").groupBy("gram", "bucket").agg(F.bitmap_or_agg("blocks").alias("blocks"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _codes(text: str) -> np.ndarray:
    """The distinct grams of three signs of a text, as numbers."""
    c = _points(text)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def _signs(codes: np.ndarray) -> pa.Array:
    """Grams from their numbers."""
    points = np.stack([codes >> np.uint64(42), (codes >> np.uint64(21)) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)], 1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _least(text: str) -> np.ndarray:
    """The distinct anchors of a text of ``BEGIN`` signs or more: of each place, the least hash of the ``ANCHOR`` signs that begin
    within ``BEGIN``. A text has all anchors of what it holds."""
    h, width, factor = _points(text) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < ANCHOR:  # of twice as many signs
        h, factor, width = h[:-width] * np.uint64(factor) + h[width:], factor * factor % (1 << 64), 2 * width
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    least = h[: len(h) - (BEGIN - ANCHOR)].copy()
    for i in range(1, BEGIN - ANCHOR + 1):
        np.minimum(least, h[i : i + len(least)], out=least)
    return np.unique(least)


def anchors(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of rows, and ``anchor``: a row for each of a text's anchors (``_least``); texts under ``BEGIN`` signs
    have none."""
    keys = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_least(t) for t in batch.column(len(keys)).to_pylist()]
            each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            at = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(each) for i in range(len(keys))], pa.array(at)], [*keys, "anchor"])

    types = {**{f.name: f.dataType.simpleString() for f in rows.schema if f.name != text}, "anchor": "long"}
    return rows.where(F.length(text) >= BEGIN).select(*keys, text).mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in types.items()))


def _set_bits(bits: Column) -> Column:
    """Positions of the bits that are set in a bitmap of 4,096 bytes, through the bytes that are not zero."""
    byte = lambda i: F.substring(bits, i + 1, F.lit(1))
    some = F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda i: byte(i) != F.lit(b"\x00"))
    value = lambda i: F.conv(F.hex(byte(i)), 16, 10).cast("int")
    eight = F.array(*[F.lit(1 << j) for j in range(8)])
    own = lambda i: F.filter(F.transform(eight, lambda m, j: F.when(value(i).bitwiseAND(m) != 0, i * 8 + j)), lambda x: x.isNotNull())
    return F.flatten(F.transform(some, own))


def conditions(queries: DataFrame, stats: DataFrame, used: int = USED) -> DataFrame:
    """q, gram, needed: the ``used`` rarest grams of each query that are in the dictionary, and how many those are. A query
    without any has one row with a null gram."""
    qs = queries.select("q").distinct().where(F.length("q") > 0)
    asked = qs.select("q", F.explode_outer(grams(F.col("q"))).alias("gram")).join(stats, "gram", "left")
    known = asked.select("q", F.when(F.col("df").isNotNull(), F.col("gram")).alias("gram"), "df").distinct()
    w = Window.partitionBy("q").orderBy(F.col("df").asc_nulls_last(), "gram")  # over a query's grams
    placed = known.select("q", "gram", F.row_number().over(w).alias("r"), F.count("gram").over(Window.partitionBy("q")).alias("n"))
    return placed.where((F.col("r") <= used) & (F.col("gram").isNotNull() | (F.col("n") == 0))).select("q", "gram", F.least("n", F.lit(used)).alias("needed"))


def _anded(wanted: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """q, bucket, b: the blocks in which all grams of a query's ``conditions`` are, as bitmaps; b is never empty."""
    met = wanted.where("gram IS NOT NULL").join(bitmaps, "gram").groupBy("q", "bucket", "needed").agg(F.bitmap_and_agg("blocks").alias("b"), F.count(F.lit(1)).alias("n"))
    return met.where((F.col("n") == F.col("needed")) & (F.bitmap_count("b") > 0)).select("q", "bucket", "b")


def _blocks_of(bits: DataFrame, *keys: str) -> DataFrame:
    """keys, block: a row for each block of bitmaps (bucket, b)."""
    at = bits.select(*keys, "bucket", F.explode(_set_bits(F.col("b"))).alias("at"))
    return at.select(*keys, ((F.col("bucket") - 1) * 32768 + F.col("at")).alias("block"))


def candidate_blocks(wanted: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """q, block: the blocks in which all grams of a query's ``conditions`` are, from their bitmaps alone."""
    return _blocks_of(_anded(wanted, bitmaps), "q")


def substring_search(
    queries: DataFrame, docs: DataFrame, index: DataFrame, drop_df: int = 2, used: int = USED, doc_id: str = "doc_id", text: str = "text",
    stats: DataFrame | None = None, bitmaps: DataFrame | None = None, block: int = DOCS_A_BLOCK,
) -> DataFrame:
    """q, doc_id of documents that hold the query text. index (``trigram_index``) is needed where stats (``gram_stats``) or
    bitmaps (``bitmap_index``) are not given; these are read best from tables.

    The bitmaps of a query's rarest grams are and-ed. Queries of ``BEGIN`` signs or more then share one pass over the
    documents of all blocks that are left: the anchors of a text meet those of queries' beginnings by equality, and what meets
    is compared, so the work grows with the texts, not with texts times queries, however little the bitmaps exclude. Shorter
    queries are compared with the documents of their own blocks. A gram that was dropped from the dictionary is no condition;
    a query without any gram left is compared with every document.
    """
    stats = gram_stats(index, drop_df) if stats is None else stats
    bitmaps = bitmap_index(index, block) if bitmaps is None else bitmaps
    wanted = stored(conditions(queries, stats, used), "conditions")
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    placed, held = t.withColumn("block", F.expr(f"doc_id DIV {block}")), F.col("_t").contains(F.col("q"))
    long = wanted.where((F.length("q") >= BEGIN) & F.col("gram").isNotNull())
    some = _blocks_of(_anded(long, bitmaps).groupBy("bucket").agg(F.bitmap_or_agg("b").alias("b")))
    asked = anchors(long.select("q", F.left("q", F.lit(BEGIN)).alias("_b")).distinct(), "_b")
    met = anchors(placed.join(some, "block", "left_semi").select("doc_id", "_t"), "_t").join(asked, "anchor").select("q", "doc_id").distinct()
    found = met.join(t, "doc_id").where(held).select("q", "doc_id")
    near = candidate_blocks(wanted.where(F.length("q") < BEGIN), bitmaps).join(placed, "block")
    found = found.unionByName(near.where(held).select("q", "doc_id"))
    free = wanted.where("gram IS NULL").select("q")
    if free.isEmpty():  # no text is read for these then
        return found
    return found.unionByName(t.join(free, F.col("_t").contains(F.col("q"))).select("q", "doc_id"))


def search_report(queries: DataFrame, docs: DataFrame, stats: DataFrame, bitmaps: DataFrame, used: int = USED, block: int = DOCS_A_BLOCK) -> DataFrame:
    """q, candidates, found, there, recall, precision: what the bitmaps leave of the documents, what the search gives, and what a
    look at every text gives, for a stated set of queries. recall and precision are those of the bitmaps; precision is null
    where they leave nothing."""
    qs = queries.select("q").distinct().where(F.length("q") > 0)
    blocks = docs.select("doc_id", F.expr(f"doc_id DIV {block}").alias("block"))
    left = candidate_blocks(conditions(qs, stats, used), bitmaps).join(blocks, "block").select("q", "doc_id", F.lit(1).alias("candidate"))
    true = docs.join(qs, F.col("text").contains(F.col("q"))).select("q", "doc_id", F.lit(1).alias("true"))  # the stated queries against all texts
    both = left.join(true, ["q", "doc_id"], "full_outer")
    sums = both.groupBy("q").agg(F.count("candidate").alias("candidates"), F.count_if(F.col("candidate").isNotNull() & F.col("true").isNotNull()).alias("found"), F.count("true").alias("there"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    counts = qs.join(sums, "q", "left").select("q", *[zero(c) for c in ("candidates", "found", "there")])
    return counts.select("*", F.coalesce(share("found", "there"), F.lit(1.0)).alias("recall"), share("found", "candidates").alias("precision"))
