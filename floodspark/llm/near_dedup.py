"""Operator 3 - near-duplicate documents by b-bit MinHash.

Per document: the set of word shingles, K minima, band keys of r minima each, and the low b bits of
all minima packed into longs. Documents with equal word sequences are one class from here on.

Candidates come from equal band keys. Within a band bucket nobody is paired with everybody: members
are paired with two hubs of the bucket (the smallest id and one picked by hash), the pairs
are screened by the collision-corrected similarity of the packed signatures (bit counts), confirmed
on the full shingle sets, and the confirmed links are merged to components. Only members that share
a bucket but still lie in different components are then compared with each other, block by block on
finer packed signatures (4096 one-bit minima) made for them, and what passes the screen is confirmed
on the full sets as well. So every pair of different components that shares a bucket has been
examined, with no cap on bucket sizes, and pairs are only emitted close to the threshold.

With K = 128 in 32 bands of 4, a pair at similarity 0.8 shares a band but for odds of 5e-8; the
screens lie five standard deviations below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, released
from .components import components
from .text import Words, blob, flat, mix, slices

K, ROWS, BITS = 128, 4, 4
BANDS, WORDS_PER_SKETCH = K // ROWS, K * BITS // 64
_EVERY_NIBBLE = 0x1111111111111111
FINE_K = 4096                             # one-bit minima of the finer signatures


def _permutations(k: int):
    seeds = mix(np.arange(2 * k, dtype=np.uint64), 77 + k)
    return (seeds[:k] >> np.uint64(32)).astype(np.uint32), (seeds[k:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(w: Words, n: int):
    """(text index, hash) of the distinct shingles, sorted by text; a text of fewer than n words is
    one shingle, a text without words has none."""
    _, doc, h = w.windows(n, 3)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, w.spans_hash(w.first[short], w.first[short + 1], 5)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def _minima(doc: np.ndarray, h: np.ndarray, n: int = K):
    """(texts with shingles, n minima of each as uint32)."""
    who, begin = np.unique(doc, return_index=True)
    out = np.empty((len(who), n), np.uint32)
    if len(who):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*_permutations(n))):
            y = (x ^ a) * b
            y ^= y >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(y * np.uint32(0x85EBCA6B), begin)
    return who, out


def _signatures(shingle: int):
    def run(batches):
        for batch in batches:
            text = flat(batch.column("text"))
            for a, b in slices(text):
                w = Words(text.slice(a, b - a), lower=True)
                doc, h = shingles(w, shingle)
                n = b - a
                size = np.bincount(doc, minlength=n)
                who, m = _minima(doc, h)
                seq = [w.spans_hash(w.first[:-1], w.first[1:], 11).view(np.int64), w.spans_check(w.first[:-1], w.first[1:]).astype(np.int64)]
                band = np.zeros((len(who), BANDS), np.uint64)
                for j in range(ROWS):
                    band = mix(band + m[:, j::ROWS].astype(np.uint64), 17 + j)
                low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(who), WORDS_PER_SKETCH, -1)
                sketch = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
                at = np.full(n, -1)
                at[who] = np.arange(len(who))

                def lists(x):
                    rows = [x[i].view(np.int64) if i >= 0 else None for i in at]
                    return pa.array(rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n).cast(pa.int64()), pa.array(size.astype(np.int64)),
                     pa.array(w.counts.astype(np.int64)), pa.array(seq[0]), pa.array(seq[1]), lists(band), lists(sketch)],
                    names=["doc_id", "n_shingles", "n_words", "seq1", "seq2", "bands", "sketch"])
    return run


def _sets(shingle: int, fine: bool = False):
    """The full shingle sets; with ``fine`` also the finer signatures (lowest bit of FINE_K minima)."""
    def run(batches):
        for batch in batches:
            text = flat(batch.column("text"))
            for a, b in slices(text):
                doc, h = shingles(Words(text.slice(a, b - a), lower=True), shingle)
                cutoffs = np.searchsorted(doc, np.arange(b - a + 1))
                names = ["node", "shingles"]
                out = [batch.column("node").slice(a, b - a),
                       pa.array([blob(h[x:y]) for x, y in zip(cutoffs[:-1], cutoffs[1:])], pa.binary())]
                if fine:
                    who, m = _minima(doc, h, FINE_K)
                    packed = [None] * (b - a)
                    for i, x in zip(who, np.packbits((m & np.uint32(1)).astype(np.uint8), axis=1)):
                        packed[i] = blob(x)
                    names.append("fine")
                    out.append(pa.array(packed, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def _confirm(percent: int):
    """Keep the pairs with 100 * intersection >= percent * union on the full sets."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def screen(percent: int, k: int = K, bits: int = BITS) -> float:
    """Least estimated similarity that is looked at: five standard deviations under the threshold."""
    t, c = percent / 100, 2.0 ** -bits
    match = c + t * (1 - c)
    return t - 5 * (match * (1 - match) / k) ** 0.5 / (1 - c)


def estimate(x: str, y: str):
    """Collision-corrected similarity of two packed signatures by bit counts, as a Spark expression."""
    differ = F.lit(0)
    for i in range(WORDS_PER_SKETCH):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for s in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, s))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(_EVERY_NIBBLE)))
    c = 2.0 ** -BITS
    return ((F.lit(1.0) - differ / F.lit(float(K))) - F.lit(c)) / F.lit(1 - c)


class _Linker:
    """Confirms candidate pairs of nodes; a node may have several sets when its doc_id repeats."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int):
        self.nodes, self.docs, self.shingle, self.percent = nodes, docs, shingle, percent

    def text_of(self, nodes: DataFrame) -> DataFrame:
        """node, text of the rows of some nodes (equal word sequences have equal sets)."""
        return (self.docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
                .select(F.col("doc_id").alias("node"), "text"))

    def screened(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose packed signatures allow a link."""
        s = self.nodes.select("node", "sketch")
        return (pairs.distinct().join(s.withColumnsRenamed({"node": "a", "sketch": "x"}), "a")
                .join(s.withColumnsRenamed({"node": "b", "sketch": "y"}), "b")
                .filter(estimate("x", "y") >= screen(self.percent)).select("a", "b"))

    def sets_of(self, nodes: DataFrame, fine: bool = False) -> DataFrame:
        return cut(self.text_of(nodes).mapInArrow(released(_sets(self.shingle, fine)), "node long, shingles binary" + ", fine binary" * fine))

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are linked, decided on full sets."""
        p = cut(pairs.distinct())
        if sets is None:
            sets = self.sets_of(p.select(F.col("a").alias("node")).union(p.select("b")))
        sets = sets.select("node", "shingles")
        full = (p.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
                .join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b"))
        return cut(full.mapInArrow(released(_confirm(self.percent)), "a long, b long").distinct())


def _cross(percent: int):
    """Pairs of one block pair that lie in different components and pass the finer screen."""
    worst = FINE_K * (1 - screen(percent, FINE_K, 1)) / 2
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        own = t["block"].to_numpy()
        node, comp = t["node"].to_numpy(), t["component"].to_numpy()
        sk = np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint64).reshape(len(node), -1)
        earlier = flat(t["bands"]).flatten().to_numpy().reshape(len(node), -1)[:, :t["band"][0].as_py()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = [np.zeros((0, 2), np.int64)]
        for x in left:
            y = right[(comp[right] != comp[x]) & ((i != j) | (node[right] > node[x]))]
            hit = y[np.bitwise_count(sk[y] ^ sk[x]).sum(axis=1, dtype=np.int64) <= worst]
            hit = hit[~(earlier[hit] == earlier[x]).any(axis=1)]      # met in an earlier band already
            out.append(np.column_stack([np.full(len(hit), node[x]), node[hit]]))
        both = np.concatenate(out)
        return pa.table([pa.array(both.min(axis=1, initial=2**63 - 1)), pa.array(both.max(axis=1, initial=-2**63))], schema=schema)
    return run


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    c = components(links)
    return nodes.join(c, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, n_words, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs of non-white-space with A-Z lower-cased; a text with fewer words than a shingle is
    one shingle; texts without words (and NULL texts) have none and link with nothing. Rows that share
    a doc_id are one node. Rows with a NULL doc_id link with nothing, have a NULL component_id and are
    kept. Extra columns are ignored. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = cut(d.mapInArrow(released(_signatures(shingle)), "doc_id long, n_shingles long, n_words long, seq1 long, seq2 long, "
                           "bands array<long>, sketch array<long>"))
    linkable = sig.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(linkable.groupBy("seq1", "seq2").agg(F.min("doc_id").alias("node")))
    nodes = cut(linkable.join(classes, ["seq1", "seq2"]).filter("doc_id = node")
                .dropDuplicates(["seq1", "seq2"]).select("node", "bands", "sketch"))
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = (members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub0"),
                                                 F.min_by("node", F.xxhash64("node", F.col("band") % 4)).alias("hub1"))
              .filter("n > 1"))
    members = cut(members.join(shared, ["band", "key"]))
    linker = _Linker(nodes, d, shingle, percent)
    # A doc_id on several rows ties its classes together.
    repeated = (linkable.join(classes, ["seq1", "seq2"]).groupBy("doc_id")
                .agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    links = cut(repeated.select(F.col("doc_id").alias("a"), F.col("lo").alias("b"))
                .union(repeated.select("doc_id", "hi")))
    bare = nodes.select("node").distinct()
    star = (members.select(F.col("node").alias("a"), F.explode(F.array("hub0", "hub1")).alias("b"))
            .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    links = cut(links.union(linker.confirmed(linker.screened(star))))
    label = cut(_labelled(bare, links))
    # Buckets of three and more that still hold several components: compare across components.
    m = members.filter("n > 2").join(label, "node")
    mixed = (m.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("n").alias("n"),
                                          F.min_by("component", "node").alias("main"))
             .filter("lo <> hi").select("band", "key", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    m = m.drop("hub0", "hub1", "n").join(mixed, ["band", "key"])
    m = m.withColumn("out", F.col("component") != F.col("main"))
    # Members of the bucket's main component and outsiders get blocks of their own; main x main is never formed.
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int") + F.when(F.col("out"), 0).otherwise(F.col("blocks")))
    partners = F.sequence(F.lit(0), F.when(F.col("out"), 2 * F.col("blocks") - 1).otherwise(F.col("blocks") - 1))
    m = cut(m.select("band", "key", "node", "component", "block", partners.alias("partners")))
    sets = linker.sets_of(m, fine=True)
    m = (m.join(nodes.select("node", F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("bands")), "node")
         .join(sets.select("node", "fine"), "node").withColumn("partner", F.explode("partners"))
         .select("band", "key", "node", "component", "fine", "bands", "block",
                 F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j")))
    pairs = m.groupBy("band", "key", "i", "j").applyInArrow(_cross(percent), "a long, b long")
    links = cut(links.union(linker.confirmed(pairs, sets)))
    label = _labelled(bare, links)
    by_class = classes.join(label, "node").select("seq1", "seq2", "component")
    return (sig.join(by_class, ["seq1", "seq2"], "left")
            .select("doc_id", "n_shingles", "n_words",
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
