"""Near-duplicate detection by BagMinHash.

A document is the multiset of its runs of five words (split at white space, lower-cased;
a text of fewer words is one run). Its signature is drawn from Poisson processes over
discretised weights: the weights of a shingle are cut into the shells [0,1), [1,2),
[2,4), [4,8), ...; each shell of a shingle has a process with a rate as wide as the shell,
whose points fall on a level of the shell and on one of ``COMPONENTS``, and count if the
shingle's weight lies above the level. A component keeps the earliest point. Points come
in order of time, so a process stops once it is later than all components, and most
shingles cost one or two points. Two signatures agree in a component with a probability
equal to the weighted Jaccard similarity.

Equal texts are one node. Signatures are cut into ``BANDS`` of four components; nodes
with an equal band share a bucket. A bucket names a leader, the member whose buckets are
largest, and every other is its candidate. Candidates whose signatures agree in too few
components to come from similar texts (``FLOOR``, 4.5 standard deviations below the
threshold) are put off; the multiset overlap of all others is verified. Verified links
join components. Then every bucket that still holds several is compared exactly: the
overlap of each two members of different components, whatever their signatures, in blocks
of bounded size. So most buckets cost k candidates, and only what is left costs up to k*k
comparisons, which stay inside their block: of its links it gives a spanning forest. No
pair that shares a band is passed over; at similarity 0.8 a pair shares none with a
probability of 5e-8.

Null texts are each alone, and so are texts without a word unless they are equal. Null
ids take part and never name a class that has another id. No row is dropped, repeated
rows are repeated in the result, no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.components import components
from ledgerlake.llm.hashing import Powers, WordHashes, mix, windows
from ledgerlake.llm.store import bounded_batches, release, write_table

BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
SHINGLE = 5
THRESHOLD = 0.8
#: Share of equal components under which a leader's candidate is put off to the blocks.
FLOOR = 0.64
#: Members of a part of a bucket and bytes of their multisets; a block holds two parts.
PART, PART_BYTES = 1000, 4 << 20
#: Pairs of one node that meet in one place, unless that makes over 10,000 such nodes.
PAIRS = 400
_CHUNK = 1 << 18
#: Bits of the map of wanted nodes; 8 MB.
BITMAP = 1 << 26


def shingles(text: str, hashes: WordHashes, powers: Powers) -> np.ndarray:
    h = hashes.of(text.lower().split())
    return windows(h, min(SHINGLE, len(h)), powers) if len(h) else h


def multiset(shingled: np.ndarray) -> np.ndarray:
    """A sorted set with one 32-bit value for each shingle and repetition of it. Of n
    shingles two different ones coincide with probability below n**2 / 2**33."""
    keys = np.sort(shingled)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    nth = (np.arange(len(keys)) - start).astype(np.uint64)
    return np.unique((mix(keys + nth * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32))


def signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x COMPONENTS values of 16 bits, from (shingle, weight, document) triples sorted
    by document; every document must have a shingle."""
    m = COMPONENTS
    shells = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(keys)), shells)
    shell = np.arange(len(at)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell == 0, 0, 1 << np.maximum(shell - 1, 0)).astype(np.float64)
    width = np.where(shell == 0, 1, 1 << np.maximum(shell - 1, 0)).astype(np.float64)
    seed = mix(keys[at] + mix(shell.astype(np.uint64) + np.uint64(1)))
    doc, weight = owner[at], weights[at].astype(np.float64)
    time, best = np.zeros(len(at)), np.full((n, m), np.inf)
    flat, step = best.reshape(-1), 0
    while len(seed):
        step = (step + 0xD1342543DE82EF95) % (1 << 64)
        r = mix(seed + np.uint64(step))
        time += -np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (width * m)
        s = mix(r)
        level = low + np.floor((s >> np.uint64(32)) * 2.0**-32 * width)
        counts = level < weight
        np.minimum.at(flat, doc[counts] * m + (s[counts] & np.uint64(m - 1)).astype(np.int64), time[counts])
        here = doc[np.concatenate([[True], doc[1:] != doc[:-1]])]
        latest = np.zeros(n)
        latest[here] = best[here].max(1)
        go = time < latest[doc]
        seed, doc, weight, time, width, low = (x[go] for x in (seed, doc, weight, time, width, low))
    return (mix(best.view(np.uint64)) >> np.uint64(48)).astype("<u2")


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, node, sig): the node is a hash of the text, null if that is null; the
    signature is null if the text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            nodes = [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            sigs: list[bytes | None] = [None] * len(texts)
            todo: list[tuple[int, np.ndarray, np.ndarray]] = []
            size = 0

            def flush(todo: list, sigs: list) -> None:
                lengths = [len(k) for _, k, _ in todo]
                made = signatures(np.concatenate([k for _, k, _ in todo]), np.concatenate([c for _, _, c in todo]), np.repeat(np.arange(len(todo)), lengths), len(todo))
                for (i, _, _), row in zip(todo, made, strict=True):
                    sigs[i] = row.tobytes()

            for i, t in enumerate(texts):
                h = shingles(t, hashes, powers) if t else ()
                if len(h):
                    todo.append((i, *np.unique(h, return_counts=True)))
                    size += len(todo[-1][1])
                if size > _CHUNK:
                    flush(todo, sigs)
                    todo, size = [], 0
            if todo:
                flush(todo, sigs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc", "node", "sig"])
        release()

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType())]))


def band_rows(nodes: DataFrame) -> DataFrame:
    """(i, band, node): the number of a band, and it with its components in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u8").reshape(-1, BANDS)
            bands = mix(sig ^ salt).view(np.int64).reshape(-1)
            numbers = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(bands), nodes], ["i", "band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "i int, band long, node binary")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, COMPONENTS) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).mean(1))], ["a", "b", "share"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            same = len(np.intersect1d(x, y, assume_unique=True))
            out.append(same / max(1, len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def spanning(roots: list[bytes], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the links between members ``left`` and ``right`` (None: among
    ``left``) of different roots, as pairs of roots."""
    label = np.unique(roots, return_inverse=True)[1]
    if (label == label[0]).all():
        return
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), bool)
    left = left[np.argsort(sizes[left], kind="stable")]
    others = left if right is None else right[np.argsort(sizes[right], kind="stable")]
    # Of sets further apart in size than the threshold the overlap can't reach it.
    first = np.arange(1, len(left) + 1) if right is None else np.searchsorted(sizes[others], threshold * sizes[left] - 1e-6)
    last = np.searchsorted(threshold * sizes[others], sizes[left] + 1e-6, "right")
    for a, lo, hi in zip(left.tolist(), first.tolist(), last.tolist(), strict=True):
        near = others[lo:hi]
        near = near[label[near] != label[a]]
        if not len(near):
            continue
        mark[places[a]] = True
        starts = np.cumsum(sizes[near]) - sizes[near]
        same = np.add.reduceat(mark[np.concatenate([places[b] for b in near.tolist()])], starts, dtype=np.int64)
        mark[places[a]] = False
        for b in near[same / (sizes[a] + sizes[near] - same) >= threshold].tolist():
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                yield roots[a], roots[b]


def compare(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of roots in the blocks (band, p, q) of ``members`` (band, p, q, part,
    root, shingled); part p meets part q, or itself."""

    def of_block(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        part = np.array([x["part"] for x in rows])
        p, q = rows[0]["p"], rows[0]["q"]
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q) if p != q else None
        if not len(left) or (right is not None and not len(right)):
            return []
        return list(spanning([x["root"] for x in rows], [np.frombuffer(x["shingled"], "<u4") for x in rows], left, right, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        found: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["band"], row["p"], row["q"])) != block:
                    found += of_block(held) if held else []
                    block, held = key, []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if held and (found := of_block(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])
        release()

    blocks = members.select("band", "p", "q", "part", "root", "shingled").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return blocks.mapInArrow(run, "a binary, b binary")


def bitmap(places: DataFrame) -> np.ndarray:
    """Bits at ``place``, ``BITMAP`` of them however many rows there are: what isn't set is
    surely not among them."""
    place = F.col("place")
    words = places.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("b"))
    out = np.zeros(BITMAP // 64, np.int64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out


def multisets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, shingled) of the ``wanted`` nodes, once each. A bitmap of fixed size spares
    most other texts the work; the join leaves out the rest."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint").bitwiseAND(BITMAP - 1).alias("place"))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            nodes, sets = [], []
            for t in batch.column(0).to_pylist():
                node = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
                place = int.from_bytes(node[:4], "big") & (BITMAP - 1)
                if bits.value[place >> 6] >> (place & 63) & 1:
                    nodes.append(node)
                    sets.append(multiset(shingles(t, hashes, powers)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingled"])
        release()

    texts = docs.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    made = texts.mapInArrow(keyed, "node binary, shingled binary").filter(F.length("shingled") > 0)
    # Copies of a text are one row of each task before they meet.
    return made.groupBy("node").agg(F.first("shingled").alias("shingled")).join(wanted, "node", "left_semi")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row its ``doc_id``, ``text_id`` (smallest id with an equal text) and
    ``class_id`` (smallest id that links of similar texts lead to)."""
    bounded_batches(docs.sparkSession)
    sketched = write_table(sketch(docs, doc_id, text), "sketch")
    nodes = write_table(sketched.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("text_id"), F.first("sig").alias("sig")), "nodes")
    bands = band_rows(nodes.filter("sig IS NOT NULL"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    members = bands.join(shared.select("band", "n"), "band")
    # Nodes that share a bucket, with their bands by number and how large their buckets are.
    own = write_table(members.groupBy("node").agg(F.sum("n").alias("central"), F.map_from_entries(F.collect_list(F.struct("i", "band"))).alias("bands")), "own")
    wanted = own.select("node")
    sets = write_table(multisets(docs, text, wanted), "sets")
    sigs = write_table(nodes.join(wanted, "node", "left_semi").select("node", "sig"), "sigs")
    roots = None

    def rooted(rows: DataFrame, column: str, out: str) -> DataFrame:
        if roots is None:
            return rows.withColumn(out, F.col(column))
        named = roots.select(F.col("node").alias(column), F.col("root").alias("_r"))
        return rows.join(named, column, "left").withColumn(out, F.coalesce("_r", F.col(column))).drop("_r")

    def beside(pairs: DataFrame, things: DataFrame, column: str, out: str, made: Callable, schema: str) -> DataFrame:
        """``made`` over pairs and what ``things`` hold of both. Few pairs are sent to the
        things, which then stay where they are. A node with many pairs, as leaders have, is
        there several times, and each of its pairs meets one of these."""
        heavy = max(PAIRS, pairs.count() // 10_000)

        def side(x: str) -> DataFrame:
            rows = pairs.withColumn("node", F.col(x))
            # At most 10,000 nodes on either side of a pair have so many.
            parts = F.broadcast(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("node", F.ceil(F.col("n") / heavy).cast("int").alias("parts")))
            salted = rows.join(parts, "node", "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int"))
            copies = things.join(parts, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
            return copies.join(salted, ["node", "salt"]).select("a", "b", F.col(column).alias(f"{out}_{x}"))

        return side("a").join(side("b"), ["a", "b"]).select("a", "b", f"{out}_a", f"{out}_b").mapInArrow(made, schema)

    # The most central member leads, from whose text the others were made if any was.
    rows = own.select("node", "central", F.explode(F.map_values("bands")).alias("band"))
    leaders = rows.groupBy("band").agg(F.max_by("node", F.struct("central", F.xxhash64("node"))).alias("l"))
    pairs = rows.join(leaders, "band").filter("node <> l").select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
    agreed = beside(write_table(pairs, "pairs"), sigs, "sig", "sig", _agree, "a binary, b binary, share double")
    likely = write_table(agreed.filter(F.col("share") >= FLOOR).select("a", "b"), "likely")
    checked = beside(likely, sets, "shingled", "set", _overlap, "a binary, b binary, similarity double")
    links = write_table(checked.filter(F.col("similarity") >= threshold).select("a", "b"), "links")
    if not links.isEmpty():
        roots = write_table(components(links), "roots")

    # Buckets of several components, one of those with the same members.
    sized = rooted(own, "node", "root").join(sets.select("node", F.length("shingled").alias("size")), "node")
    rows = write_table(sized.select("node", "root", "size", F.explode(F.map_values("bands")).alias("band")), "members")
    still = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND((1 << 31) - 1)).alias("y")).filter("lo <> hi")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES))
    still = still.groupBy("n", "bytes", "first", "last", "x", "y").agg(F.min("band").alias("band")).select("band", parts.cast("int").alias("parts"))
    members = rows.join(still, "band").withColumn("part", F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int"))
    blocks = members.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    more = write_table(compare(blocks, threshold), "links")
    if not more.isEmpty():
        roots = write_table(components(links.unionByName(more)), "roots")
    ids = rooted(nodes.select("node", "text_id"), "node", "root")
    classes = ids.groupBy("root").agg(F.min("text_id").alias("class_id"))
    named = ids.join(classes, "root").select("node", "text_id", "class_id")
    out = sketched.select("doc", "node").join(named, "node", "left")
    return out.select(F.col("doc").alias(doc_id), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("text_id")).alias("text_id"), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"))
