"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two that differ in at most d bits agree in at least 8 - d of them, since each
bit spoils one byte at most. The index posts each distinct fingerprint under combinations of positional bytes, chosen
so that whichever 8 - d positions agree, one whole combination is among them; single-byte postings would be 1/256 of
all fingerprints, those of three bytes are one in sixteen million. Within a posting, shared positional bytes are
tallied per pair, pairs that reach the guaranteed 8 - d go on, and their differing bits are counted.

Only what connectivity needs leaves a posting: a spanning forest of its links, never all pairs. A large posting is
cut into blocks and each pair of blocks is a group of its own, so no group holds more than two blocks and no link is
lost. Exact copies share one fingerprint and never meet in pairs.

Texts are read whole, however long. Nulls count as empty texts; texts of no words have fingerprint zero and are linked like any other. A null doc_id is
kept with its fingerprint, and never names a component that has another doc_id. Repeated rows come back as often
as they came. An empty table gives no rows. Extra columns don't matter.

`one_of_each` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of such
texts differ in up to about 15 % of the bits, too many for a guarantee, so it takes fingerprints of 64 positional bytes.
Each text is posted under those combinations of them whose bits are the least likely to change, so many that a pair at
0.8 itself meets with a probability of 0.95 or more. Pairs of a posting tally their shared positional bytes, and those
below what 0.8 all but guarantees (three standard errors) go, as do those of too many bits. Pairs that this misses meet
all the same: a text is also posted under its rarest shingles, one more than a text at 0.8 may lack, so that any two such
texts share one; there only pairs go that are eight standard errors too far. What is left connects
texts into claims; each claim's shingles come together once and links are decided on them alone. Texts of equal words
are one, whatever their length. Very long texts are read whole; a claim's blocks are bounded by shingles as well as
texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, components, fixed_bytes, fresh, in_blocks, join_counted, materialize, spanning_links, whole_groups

SEED = 42
#: Rows of a block: postings are cut into blocks of the first size up to SPREAD blocks, then into SPREAD larger ones, up to the second.
BLOCK, SPREAD, LARGEST = 256, 32, 8192
#: Shingles counted at once.
SHINGLES = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a whole text's word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=True)])
        rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        for lo in range(0, len(rows), 255):  # counts of 255 rows fit a byte
            ones += np.add.reduce(np.unpackbits(rows[lo : lo + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""
    import pyarrow as pa

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, fp long")


def cover(agree: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` byte positions such that any `agree` of the eight hold one of them whole; found greedily."""
    wanted = set(itertools.combinations(range(8), agree))
    sets = []
    while wanted:
        best = max(itertools.combinations(range(8), size), key=lambda s: (sum(set(s) <= set(w) for w in wanted), s))
        sets.append(best)
        wanted = {w for w in wanted if not set(best) <= set(w)}
    return sets


def _near(fp: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """Whether each pair shares the guaranteed positional bytes and differs in at most `bits` bits."""
    x = np.bitwise_xor(fp, others).view(np.uint64)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def links(fps: DataFrame, bits: int, rows: int, block: int = BLOCK, spread: int = SPREAD, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node); what they connect is what all pairs within `bits` connect."""
    import pyarrow as pa

    agree = 8 - bits
    if agree < 1:
        raise ValueError("a positional byte must be sure to agree: at most 7 differing bits")
    # The more fingerprints, the longer the combinations, so that a posting by chance stays rare.
    size = next((s for s in range(1, agree) if rows * len(cover(agree, s)) < 256**s), agree)
    keys = []
    for k, places in enumerate(cover(agree, size)):
        mask = sum(0xFF << (8 * p) for p in places)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    posts = fps.select("fp", "node", F.explode(F.array(*keys)).alias("p")).select("p.k", "p.key", "fp", "node")
    group = ["k", "key", "lo", "hi"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 4):
            fp, node = (rows.column(k).to_numpy() for k in (4, 5))
            for i, j in spanning_links(starts, len(fp), lambda i, j, fp=fp: _near(fp[i], fp[j], bits)):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    bounded_batches(fps.sparkSession)
    dealt = in_blocks(posts, ["k", "key"], "fp", block, spread, largest).select(*group, "fp", "node")
    return dealt.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(search, "a long, b long").distinct()


def classes(docs: DataFrame, width: int = 4, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links of at most `bits` differing bits)."""
    marked = materialize(fingerprints(docs, width))
    firsts = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    rows, last = firsts.agg(F.count(F.lit(1)), F.max("first")).first()
    last = -1 if last is None else last
    # A fingerprint is named by its smallest doc_id, so components need no second look-up; without any, by a number beyond all.
    named = materialize(firsts.withColumn("node", F.coalesce("first", F.lit(last + 1) + F.monotonically_increasing_id())))
    members = components(links(named.select("fp", "node"), bits, rows, block))
    least = F.coalesce("component", "node")
    of = named.join(members, "node", "left").select("fp", "copies", F.when(least <= last, least).alias("component_id"))
    return join_counted(marked, of, "fp", "copies").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of 64 bits in a wide fingerprint.
WIDE = 8
#: Standard errors by which a candidate's bits and tally may miss what its similarity leads to expect.
MAY_ERRORS = 3.0
#: The same where texts share a rare shingle, which is to miss none: a pair at 0.8 goes with a chance below 1e-12, of sets of 4 and 5 below 1e-6.
SURE_ERRORS = 8.0
#: Texts whose shingles are counted to tell common ones, how many must hold one, and how many of the commonest are told. They
#: only order shingles: whatever the order, texts that are alike share one of those that they are posted under.
COMMON_OF, COMMON, COMMONEST = 8192, 3, 1 << 16
#: Bytes of a shingle's hash in a posting, and the key from which postings are of shingles.
RARE_BYTES, RARE_KEYS = 5, 1 << 40
#: Combinations of so many positional bytes: how many there are, and under how many of these a text is posted; one length for tables of any size.
POSTED = {3: (600, 230)}
#: Ids of documents, up to which they are broadcast, 32 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def shingles(text: str | None, width: int = 5) -> tuple[bytes, np.ndarray]:
    """A whole text's words with one blank between, and the sorted hashes of its distinct shingles."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if not words:
        return line, np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[: max(0, len(words) - width)].tolist()]
    last = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    return line, np.unique(np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)]), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 512-bit SimHash of distinct shingles' hashes, as 64 positional bytes, and 64 bytes of how steadfast each is."""
    n = len(hashes)
    if not n:
        return np.zeros(16 * WIDE, np.uint8)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, n, SHINGLES):
        h = hashes[at : at + SHINGLES]
        for k in range(WIDE):  # further bits come from the first by mixing
            mixed = (h ^ np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            rows = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1)
            for lo in range(0, len(rows), 255):
                ones[64 * k : 64 * k + 64] += np.add.reduce(rows[lo : lo + 255], axis=0, dtype=np.uint8)
    return np.r_[np.packbits(2 * ones > n), steadfast(np.abs(2 * ones - n) / math.sqrt(n))]


def steadfast(margins: np.ndarray) -> np.ndarray:
    """How likely each byte's eight bits are to stay in a near-duplicate, by their margins in standard deviations: 255 at most."""
    stay = -np.log1p(np.exp(-3.3 * margins)).reshape(-1, 8).sum(axis=1)
    return np.rint(255 * np.maximum(0, 1 + stay / 5.6)).astype(np.uint8)


def differing(similarity: float) -> tuple[int, int]:
    """The most bits that wide fingerprints of that Jaccard similarity may differ in, and the fewest positional bytes to share."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    same, n = (1 - p) ** 8, 64 * WIDE
    return int(n * p + MAY_ERRORS * math.sqrt(n * p * (1 - p))), max(1, int(8 * WIDE * same - MAY_ERRORS * math.sqrt(8 * WIDE * same * (1 - same))))


def farthest(similarity: float) -> int:
    """The most bits that wide fingerprints of that similarity differ in, of all but certainly all pairs."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(64 * WIDE * p + SURE_ERRORS * math.sqrt(64 * WIDE * p * (1 - p)))


def common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and in how many of some texts each is."""
    import pyarrow as pa

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), width)[1].view(np.int64))], names=["hash"])

    share = math.ceil(min(1.0, COMMON_OF / max(1, docs.count())) * (1 << 20))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text").mapInArrow(each, "hash long")
    found = some.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "hash").limit(COMMONEST).collect()
    hashes, n = np.array([r["hash"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def rarest(hashes: np.ndarray, similarity: float, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of sorted hashes the first by (how common, hash), one more than a set of that similarity may lack: two such sets share one."""
    n = len(hashes)
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, often[at], 0)
    return hashes[np.argsort(rank, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]]


def rare_bytes(hashes: np.ndarray) -> bytes:
    """The high bytes of hashes, RARE_BYTES each."""
    return (hashes >> np.uint64(64 - 8 * RARE_BYTES)).view(np.uint8).reshape(-1, 8)[:, :RARE_BYTES].tobytes()


def rare_keys(column) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a column of rare_bytes, and how many each row has."""
    rows = [b.as_py() for b in column]
    keys = np.zeros((sum(map(len, rows)) // RARE_BYTES, 8), np.uint8)
    keys[:, :RARE_BYTES] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, RARE_BYTES)
    return keys.view(np.int64).reshape(-1) + RARE_KEYS, np.array([len(b) // RARE_BYTES for b in rows], np.int64)


def combinations(size: int) -> np.ndarray:
    """The combinations of positional bytes, as rows of positions."""
    g = np.random.default_rng(SEED)
    return np.array([np.sort(g.choice(8 * WIDE, size, replace=False)) for _ in range(POSTED[size][0])])


def postings(wide: np.ndarray, size: int) -> np.ndarray:
    """Keys of each text: its most steadfast combinations, with the bytes there."""
    combos, posted = combinations(size), POSTED[size][1]
    marks, firm = wide[:, : 8 * WIDE].astype(np.int64), wide[:, 8 * WIDE :].astype(np.int64)
    keys = np.tile(np.arange(len(combos)), (len(wide), 1))
    for place in combos.T:
        keys = keys << 8 | marks[:, place]
    best = np.argsort(-firm[:, combos].sum(axis=2), axis=1, kind="stable")[:, :posted]
    return np.take_along_axis(keys, best, 1)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of (node, wide, n, rare) that connect all which share a posting and whose bits may mean the similarity; of combinations, also a tally of positional bytes."""
    import pyarrow as pa

    (most, least), far, (size,) = differing(similarity), farthest(similarity), POSTED

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = postings(fixed_bytes(part.column(1)), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.reshape(-1))], names=["node", "key"])
                keys, held = rare_keys(part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), held)), pa.array(keys)], names=["node", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 3):
            node, n, rare = rows.column(3).to_numpy(), rows.column(5).to_numpy(), rows.column(0).to_numpy() >= RARE_KEYS
            marks = np.ascontiguousarray(fixed_bytes(rows.column(4))).view(np.uint64)

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
                some = np.flatnonzero(ok)
                for lo in range(0, len(some), 1 << 16):
                    at = some[lo : lo + (1 << 16)]
                    x = marks[i[at]] ^ marks[j[at]]
                    tally, bits = (x.view(np.uint8) == 0).sum(axis=1), np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                    ok[at] = np.where(rare[i[at]], bits <= far, (tally >= least) & (bits <= most))
                return ok

            for i, j in spanning_links(starts, len(node), near):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    bounded_batches(nodes.sparkSession)
    group = ["key", "lo", "hi"]
    marks = nodes.select("node", F.substring("wide", 1, 8 * WIDE).alias("wide"), "n")
    posts = nodes.select("node", "wide", "rare").mapInArrow(post, "node long, key long")
    dealt = in_blocks(posts, ["key"], "node", BLOCK, SPREAD, LARGEST, once=True).select(*group, "node").join(marks, "node").select(*group, "node", "wide", "n")
    return dealt.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(search, "a long, b long").where("a <> b").distinct()


def alike(starts: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what pairs of that Jaccard similarity or more connect, within each group of sorted sets."""
    sizes = np.array([len(x) for x in sets])

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
        some = np.flatnonzero(ok)
        for first in np.unique(i[some]):  # one set against all that are left
            at = some[i[some] == first]
            mine, both = sets[first], np.zeros(len(at), np.int64)
            if len(mine):
                full = np.flatnonzero(sizes[j[at]])
                for lo in range(0, len(full), 256):
                    part = j[at[full[lo : lo + 256]]]
                    flat = np.concatenate([sets[k] for k in part])
                    found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both[full[lo : lo + 256]] = np.add.reduceat(found, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
            ok[at] = both >= similarity * (len(mine) + sizes[j[at]] - both) - 1e-9
        return ok

    yield from spanning_links(starts, len(sets), near)


def near_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, first): each document's smallest doc_id of those that its links reach, itself included."""
    import pyarrow as pa
    from xxhash import xxh128_digest

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(1)]
            columns = [pa.array([xxh128_digest(line) for line, _ in found], pa.binary()), pa.array([wide_fingerprint(h).tobytes() for _, h in found], pa.binary()), pa.array([len(h) for _, h in found], pa.int64())]
            rare = pa.array([rare_bytes(rarest(h, similarity, known, often)) for _, h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, rare], names=["doc_id", "digest", "wide", "n", "rare"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [shingles(t.as_py(), width) for t in part.column(0)]
                same = pa.array([xxh128_digest(line) == d.as_py() for (line, _), d in zip(found, part.column(1), strict=True)], pa.bool_())
                sets = pa.array([h.tobytes() for _, h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), sets], names=["node", "claim", "hashes"]).filter(same)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 3):
            node, sets = rows.column(3).to_numpy(), [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column(4)]
            for i, j in alike(starts, sets, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    bounded_batches(docs.sparkSession)
    named = docs.select("doc_id", "text").where("doc_id is not null")
    known, often = common(named, width)
    marks = materialize(named.mapInArrow(mark, "doc_id long, digest binary, wide binary, n long, rare binary"))
    nodes = materialize(marks.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.first(x).alias(x) for x in ("wide", "n", "rare")), F.count(F.lit(1)).alias("copies")))
    # What candidates connect is a claim; within it, all pairs are verified on the shingles, which come there once a block.
    pairs = candidates(nodes.select("node", "wide", "n", "rare"), similarity)
    claims = materialize(nodes.select("node", "digest").join(components(pairs), "node").withColumnRenamed("component", "claim"))
    near = F.broadcast(claims) if claims.count() <= BROADCAST_IDS else claims
    texts = named.join(near, F.col("doc_id") == F.col("node")).select("text", "digest", "node", "claim")
    sets = materialize(texts.mapInArrow(hashed, "node long, claim long, hashes binary").withColumn("n", F.floor(F.length("hashes") / 8)))
    group = ["claim", "lo", "hi"]
    met = in_blocks(sets, ["claim"], "node", BLOCK // 2, SPREAD, LARGEST, "n").select(*group, "node", "hashes")
    edges = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(verify, "a long, b long")
    members = components(edges)
    firsts = nodes.join(members, "node", "left").select("digest", "copies", F.coalesce("component", "node").alias("first"))
    return join_counted(marks.select("doc_id", "digest"), firsts, "digest", "copies").select("doc_id", "first")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The first document of each group of near-duplicates, with the columns it came with.

    Only the ids of documents that go are joined with the documents, broadcast if they are counted and few. Rows that
    repeat a doc_id stay or go together, and of those that stay and repeat its text too one is kept; a null doc_id stays.
    """
    found = near_classes(docs, width, similarity).groupBy("doc_id").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id <> first")
    gone_id, repeats = fresh("gone_id", docs), fresh("gone_repeats", docs)
    gone = materialize(found.select(F.col("doc_id").alias(gone_id), (F.col("doc_id") == F.col("first")).alias(repeats)))
    few = gone.count() <= BROADCAST_IDS
    rest = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone[gone_id], "left_anti")
    again = gone.where(F.col(repeats))
    if again.isEmpty():
        return rest
    return rest.unionByName(docs.join(again, docs["doc_id"] == again[gone_id], "left_semi").dropDuplicates(["doc_id", "text"]))
