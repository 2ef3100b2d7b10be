"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (after Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in round ``i`` every
set element is thrown into one of ``t`` bins by a hash of its own; a bin keeps the smallest
(round, hash).  From round ``t`` on, all elements go to bin ``i - t``, so each coordinate fills after
``2 t`` rounds at most.  Rounds end as soon as all bins of a set are full.

Plan: one scan makes sketches; equal sets collapse into one class by a 128-bit fingerprint; only class
representatives are banded.  In each band bucket, members are first compared with one centre, so a
group of near copies costs a row per member.  Where a bucket then still holds more than one
component, its members of *different* components meet in an exact prefix-filter join: a linked pair
shares one of the rarest fifth of the shingles of either set.  Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as tk
from parley.llm.components import connected_components
from parley.llm.store import discard, id_filter, materialise, may_hold, small_batches

BINS, ROWS_PER_BAND = 128, 4
#: Two bits of each of 128 coordinates are kept; sets of similarity s differ in (1 - s) * 3/4 of them on average.
#: At s = 0.8 that is 19 with a deviation of 4; 40 is over 5 deviations away.
MOST_DIFFERENT = 40
#: Bits of the bitmap of wanted documents; its 2 MB are the bound of what is broadcast, whatever the input.
WANTED_BITS = 1 << 24
_EMPTY = np.uint64(2**64 - 1)

SIGNATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>"


def sketches(hashes: np.ndarray, rows: np.ndarray, n_rows: int, bins: int = BINS) -> np.ndarray:
    """(n_rows, bins) coordinates of the sets given by (hash, row); rows of ``hashes`` must be sorted."""
    out = np.full(n_rows * bins, _EMPTY, dtype=np.uint64)
    h, r = hashes, rows
    for i in range(2 * bins):
        if not len(h):
            break
        thrown = tk.mix(h ^ np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        at = (thrown & np.uint64(bins - 1)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, r * bins + at, (np.uint64(i) << np.uint64(54)) | (thrown >> np.uint64(10)))
        open_rows = (out.reshape(n_rows, bins) == _EMPTY).any(axis=1)
        keep = open_rows[r]
        if not keep.all():
            h, r = h[keep], r[keep]
    return out.reshape(n_rows, bins)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, n, data, offsets in tk.text_chunks(batch.column(1)):
                start, end, row = tk.words(data, offsets)
                h, r = tk.shingle_hashes(tk.word_hashes(data, start, end), row, k)
                h, r = tk.distinct_per_row(h, r)
                count = np.bincount(r, minlength=n)
                has = count > 0
                sketch = sketches(h, r, n)
                fp = np.zeros((2, n), dtype=np.uint64)
                if len(h):
                    at = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    fp[0, has] = np.add.reduceat(tk.mix(h), at)
                    fp[1, has] = np.add.reduceat(tk.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                groups = sketch.reshape(n, BINS // ROWS_PER_BAND, ROWS_PER_BAND)
                band = np.arange(1, BINS // ROWS_PER_BAND + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
                for j in range(ROWS_PER_BAND):
                    band = tk.mix(band ^ groups[:, :, j])
                two = (tk.mix(sketch) & np.uint64(3)).reshape(n, 4, 32)
                bits = (two << (2 * np.arange(32, dtype=np.uint64))[None, None, :]).sum(axis=2, dtype=np.uint64)
                width = BINS // ROWS_PER_BAND
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n).cast(pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array(fp[0].view(np.int64)),
                        pa.array(fp[1].view(np.int64)),
                        tk.list_array(band[has].reshape(-1).view(np.int64), has * width, pa.int64()),
                        tk.list_array(bits[has].reshape(-1).view(np.int64), has * 4, pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "bits"],
                )

    return run


def _sets(k: int, wanted=None):
    """Sets of the documents whose id the bitmap ``wanted`` may hold (all without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                at = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))
            for first, n, data, offsets in tk.text_chunks(batch.column(1)):
                start, end, row = tk.words(data, offsets)
                h, r = tk.shingle_hashes(tk.word_hashes(data, start, end), row, k)
                h, r = tk.distinct_per_row(h, r)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n).cast(pa.int64()),
                        tk.list_array(h.view(np.int64), np.bincount(r, minlength=n), pa.int64()),
                    ],
                    names=["doc_id", "shingles"],
                )

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids`` (and some others), without a shuffle of texts.

    The ids go into a bitmap of fixed size that filters the scan; what passes by chance is dropped by
    the joins that follow.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(WANTED_BITS)).alias("bit")
    rows = (
        ids.select(bit)
        .groupBy(F.shiftright("bit", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
        .toPandas()
    )
    words = np.zeros(WANTED_BITS // 64, dtype=np.uint64)
    words[rows["at"].to_numpy(dtype=np.int64)] = rows["word"].to_numpy(dtype=np.int64).view(np.uint64)
    wanted = spark.sparkContext.broadcast(words)
    found = docs.select("doc_id", "text", bit).where("doc_id is not null")
    return materialise(found.mapInArrow(_sets(k, wanted), "doc_id long, shingles array<long>"), "sets")


def _different(a: Column, b: Column) -> Column:
    """Number of coordinates of which the two kept bits differ."""
    total = None
    for i in range(4):
        x = a[i].bitwiseXOR(b[i])
        y = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = F.bit_count(y) if total is None else total + F.bit_count(y)
    return total


def _near(similar: int, n1: str, n2: str, bits1: str, bits2: str) -> Column:
    """What every linked pair fulfils: a size ratio (exact) and few different coordinates."""
    return (
        (F.col(n1) * 100 >= F.col(n2) * similar)
        & (F.col(n2) * 100 >= F.col(n1) * similar)
        & (_different(F.col(bits1), F.col(bits2)) <= MOST_DIFFERENT)
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at least as similar as ``similar`` per cent."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * similar).select("a", "b")


def _cross_pairs(rest: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of different components that may link.  ``rest``: rep, component, n, bits.

    Prefix filter: with shingles in one order for all sets, rarest first, sets of n elements that link
    share one of the first n - ceil(n * similar / 100) + 1 of either.  Shingles of one set only stand
    first, so a set of which more than a fifth is its own meets nothing.
    """
    each = sets.join(rest.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    each = each.select("doc_id", F.explode("shingles").alias("shingle"))
    count = each.groupBy("shingle").agg(F.count("*").alias("df"))
    shared = each.join(count.where("df > 1").select("shingle", "df"), "shingle")
    ranked = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    facts = rest.join(ranked, rest.rep == ranked.doc_id)
    own = F.col("n") - F.size("ranked")
    prefix = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1 - own
    keys = materialise(
        facts.where(prefix > 0).select(
            "rep", "component", "n", "bits", own.alias("own"), F.posexplode(F.slice("ranked", F.lit(1), prefix.cast("int")).getField("shingle")).alias("at", "key")
        ).select("key", "rep", "component", "n", "bits", (F.col("n") - F.col("own") - F.col("at")).alias("left")),
        "prefixes",
    )
    one = keys.select("key", *(F.col(c).alias(f"{c}1") for c in ("rep", "component", "n", "bits", "left")))
    two = keys.select("key", *(F.col(c).alias(f"{c}2") for c in ("rep", "component", "n", "bits", "left")))
    # At the first key that a linked pair shares, what is left of either set holds the whole intersection.
    enough = F.least("left1", "left2") * (100 + similar) >= (F.col("n1") + F.col("n2")) * similar
    return (
        one.join(two, "key")
        .where(enough & (F.col("component1") < F.col("component2")) & _near(similar, "n1", "n2", "bits1", "bits2"))
        .select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int = 5, similar: int = 80) -> DataFrame:
    """Classes of near-duplicate documents.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A document's set is its distinct
    k-word shingles (A-Z lower-cased); with fewer words, the whole sequence is its one shingle; a null,
    empty or blank text has an empty set and links with nothing.  Two documents link when
    100 * intersection >= similar * union on the full sets.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept
    (doc_id = component_id).  A row with a null doc_id is linked with nothing: its component_id is null
    and kept is true.  Rows that repeat a doc_id are one node of the links, whichever of their texts links.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_signatures(k), SIGNATURES), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialise(
        usable.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "fp1", "fp2"], "left_semi")
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "bits"),
        "representatives",
    )
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    centres = materialise(
        banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last"),
        "centres",
    )
    members = materialise(banded.join(centres.select("bucket", "centre"), "bucket"), "members")
    facts = reps.select("rep", "n", "bits")
    fact_a = facts.select(F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    fact_b = facts.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    stars = members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    near = materialise(
        stars.join(fact_a, "a").join(fact_b, "b").where(_near(similar, "n1", "n2", "bits1", "bits2")).select("a", "b"),
        "near",
    )
    ends = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets_of(ends, docs, k)
    links = materialise(_confirmed(near, sets, similar), "links")
    discard(sets)
    parts = materialise(connected_components(links), "components")

    # Buckets that still hold several components: compare members of different components.
    placed = materialise(
        members.join(parts, members.rep == parts.node, "left").select(
            "bucket", "rep", F.coalesce("component", "rep").alias("component")
        ),
        "placed",
    )
    mixed = materialise(
        placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2"),
        "mixed",
    )
    rest = materialise(
        placed.join(mixed.select("bucket"), "bucket").select("rep", "component").distinct().join(facts, "rep"), "rest"
    )
    sets = _sets_of(rest.select(F.col("rep").alias("doc_id")), docs, k)
    more = materialise(_confirmed(_cross_pairs(rest, sets, similar), sets, similar), "links")
    if not more.isEmpty():
        parts = materialise(connected_components(links.unionByName(more)), "components")
    for table in (members, placed, mixed, rest, centres, sets, near):
        discard(table)

    of_class = materialise(
        classes.join(parts, classes.rep == parts.node, "left").select(
            "fp1", "fp2", F.coalesce("component", "rep").alias("component")
        ),
        "class_components",
    )
    for table in (classes, reps, links, more, parts):
        discard(table)
    linked = usable.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, ["fp1", "fp2"])
    alone = signed.where("n_shingles = 0 or doc_id is null")
    return linked.select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept")
    ).unionByName(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, k: int = 5, similar: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class is kept; all columns are returned.

    Rows with a null doc_id stay.  Rows that repeat a kept doc_id stay once if their whole row repeats.
    """
    found = near_duplicates(docs, k, similar)
    gone = materialise(found.where("not kept").select("doc_id").distinct(), "gone")
    repeated = materialise(
        docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"
    )
    # Only documents that may go are shuffled.
    maybe = may_hold(id_filter(gone, always=True), F.col("doc_id").cast("long"))
    stay = docs.where(~maybe).unionByName(docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns))
    if not repeated.isEmpty():
        again = stay.join(repeated, "doc_id", "left_semi").dropDuplicates()
        stay = stay.join(repeated, "doc_id", "left_anti").unionByName(again)
    return stay.select(*docs.columns)
