"""SimHash near-duplicates by pivot distance tables.

Fingerprints: 64 bits, each the majority of that bit among the XXH64 hashes of
the text's word shingles. Equal fingerprints are collapsed first (a count on the
map side), so copies never meet each other.

Pivot table: reference fingerprints, in pairs (p, p with a pair of bits turned);
the Hamming distances of a fingerprint x to both references of a pair tell how
many of the two bits are set, and each pair of distances is one coordinate
(0, 1 or 2). One changed bit changes one coordinate by 1, so two fingerprints
within d bits differ in at most d coordinates, and by at most d in each. There
are 32 coordinates. They are cut into d + 3 groups; fingerprints within d bits
agree on all coordinates of at least 3 groups, so every choice of 3 groups is a
join key, and only fingerprints that share a key meet. Inside a key, pairs whose
largest coordinate difference against further reference fingerprints (fixed
pseudo-random ones) exceeds d are discarded, and survivors are verified bit by
bit. A key with many members is first split by a second pivot table, whose bit
pairs are others, before its members are compared.

A key's task returns a spanning forest of its links, not all pairs; connected
components over those edges are found by Spark joins (``components``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: The contract's shingle length and largest distance.
WORDS, BITS = 3, 2
#: Pairs of bits turned by the references of the pivot tables: neighbours, then bits 32, 16 and 8 apart.
PAIRINGS = (1, 32, 16, 8)
#: Reference fingerprints for the coordinate differences inside a key.
PIVOTS = np.random.default_rng(1).integers(0, 2**64, 16, dtype="u8")
#: Members of a key above which a further pivot table splits it.
SPLIT = 512


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of a UTF-8 text; 0 without words."""
    import xxhash
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], "u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, w), "i8", len(w)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(begins[:len(w) - words + 1].tolist(), ends[words - 1:].tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), "u8", len(w) - words + 1)
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):  # whole texts, a bounded block of bits at a time
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view("u1"), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype="i8")
    return int((2 * counts > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype="u8")))


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 words: int = WORDS, keep: tuple = ()) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long), and the columns named
    in ``keep``, of every row."""
    inner = documents.select(F.col(id_column).cast("long").alias("doc_id"), common.text_of(text_column).alias("text"), *keep)

    def made(batches):
        for b in common.slices(batches, 256):
            fps = [fingerprint(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, "u8").view("i8")),
                                              *[b.column(c) for c in keep]], ["doc_id", "fp", *keep])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in inner.schema.fields if f.name in keep)
    return common.map_arrow(inner, made, f"doc_id long, fp long{more}")


def coordinates(fps: np.ndarray, apart: int) -> np.ndarray:
    """(fingerprints, 32) pivot coordinates: for each pair of references (p,
    and p with bits i and i + apart turned) the difference of the distances to
    both, as the number of the two bits that are set."""
    low = [i for i in range(64) if not i & apart]
    turned = np.array([(1 << i) | (1 << (i + apart)) for i in low], "u8")
    to_p = np.bitwise_count(fps).astype("i2")[:, None]  # p is the zero fingerprint
    to_turned = np.bitwise_count(fps[:, None] ^ turned).astype("i2")
    return ((to_p - to_turned + 2) // 2).astype("u1")


def join_keys(fps: np.ndarray, bits: int, apart: int) -> np.ndarray:
    """(fingerprints, keys): 64-bit join keys. Fingerprints within ``bits``
    share at least one; others may."""
    c = coordinates(fps, apart)
    groups = np.array_split(np.arange(32), bits + 3)
    codes = []
    for g in groups:
        code = np.zeros(len(fps), "u8")
        for j in g:
            code = code * np.uint64(3) + c[:, j]
        codes.append(code)
    out = []
    with np.errstate(over="ignore"):
        for n, chosen in enumerate(combinations(range(len(groups)), 3)):
            # three groups together are at most 3^21 values (bits <= 2) and else are mixed: a clash only adds candidates
            key = np.full(len(fps), n, "u8")
            for g in chosen:
                key = key * np.uint64(3 ** len(groups[g])) + codes[g]
            out.append(key * np.uint64(64) + np.uint64(n))
    return np.stack(out, 1)


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _compare(fps, members, bits, forest) -> None:
    own = fps[members]
    table = np.bitwise_count(own[:, None] ^ PIVOTS).astype("i2")
    for at in range(0, len(own), 256):
        a = slice(at, at + 256)
        near = np.ones((len(own[a]), len(own)), bool)
        for p in range(table.shape[1]):  # largest coordinate difference
            near &= np.abs(table[a, p][:, None] - table[None, :, p]) <= bits
        i, j = np.nonzero(near)
        i, j = i[i + at < j] + at, j[i + at < j]
        linked = np.bitwise_count(own[i] ^ own[j]) <= bits
        for x, y in zip(members[i[linked]].tolist(), members[j[linked]].tolist()):
            forest.join(x, y)


def links(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of one key:
    (member, its root) for all members that are not roots."""
    fps = np.sort(fps)
    forest = Forest(len(fps))

    def work(members: np.ndarray, table: int) -> None:
        if len(members) < 2:
            return
        if len(members) <= SPLIT or table >= len(PAIRINGS):
            _compare(fps, members, bits, forest)
            return
        keys = join_keys(fps[members], bits, PAIRINGS[table])
        for column in keys.T:
            order = np.argsort(column, kind="stable")
            cuts = np.flatnonzero(np.diff(column[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    work(np.sort(members[part]), table + 1)

    work(np.arange(len(fps)), 1)
    roots = np.array([forest.root(i) for i in range(len(fps))], dtype=int)
    below = roots != np.arange(len(fps))
    return fps[below], fps[roots[below]]


def _candidate_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(u, v): edges that join all fingerprints linked directly or through
    others in the same key."""

    def keyed(batches):
        for b in common.slices(batches, 4096):
            fps = b.column("fp").to_numpy(zero_copy_only=False).view("u8")
            keys = join_keys(fps, bits, PAIRINGS[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(fps, keys.shape[1]).view("i8"))],
                                             ["key", "fp"])

    def linked(batches):
        # rows come sorted by key; a key's members may go on in the next batch
        held_key, held = None, []

        def finish():
            members = np.concatenate(held)
            if len(members) > 1:
                a, b = links(members, bits)
                if len(a):
                    return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], ["u", "v"])
            return None

        for b in batches:
            key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and key[s] != held_key:
                    if (out := finish()) is not None:
                        yield out
                    held = []
                held_key = key[s]
                held.append(fp[s:e].view("u8"))
        if held and (out := finish()) is not None:
            yield out

    rows = common.map_arrow(distinct.select("fp"), keyed, "key long, fp long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "key").sortWithinPartitions("key")
    return common.map_arrow(ordered, linked, "u long, v long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits),
    component_id (the smallest id of a document reachable over links of at most
    ``bits`` differing bits). Null and empty texts have fingerprint zero and
    are linked like any other. A null id takes its component's smallest id;
    repeated rows are repeated in the result; an empty table gives no rows."""
    rows = common.written(fingerprints(documents, id_column, text_column, words), "simhash")
    members = common.written(classes(rows, bits), "simhash-classes")
    return (rows.join(members, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def classes(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in (doc_id, fp);
    root is a fingerprint that names the component."""
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    of = components(_candidate_links(distinct, bits))
    placed = common.written(distinct.join(of, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root")), "simhash-placed")
    least = common.written(placed.groupBy("root").agg(F.min("id").alias("component_id")), "simhash-roots")
    return placed.join(least, "root").select("fp", "root", "component_id")


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The input's rows, one of each component: the one with the smallest id
    (any one of them, if the id is repeated in the component). All columns as
    they were. In a component whose ids are all null one row stays."""
    rows = documents.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("id"),
                            common.text_of(text_column).alias("text"))
    fps = common.written(fingerprints(documents, id_column, text_column, words), "simhash")
    members = common.written(classes(fps, bits), "simhash-classes")
    ids = common.written(fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")), "simhash-ids")
    # An id that occurs once stays if its component names it; only those ids meet the texts again.
    once = ids.where("n = 1 and doc_id is not null").join(members, "fp").where("doc_id = component_id").select("doc_id")
    kept = rows.join(once, F.col("id") == F.col("doc_id"), "left_semi").select("row")
    # Repeated and null ids do not tell a row: their fingerprints are made again, with the rows.
    twice = common.written(ids.where("n > 1 or doc_id is null").select("doc_id"), "simhash-twice")
    again = rows.join(twice, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    again = (fingerprints(again, "id", "text", words, keep=("row",)).join(members, "fp")
             .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root").agg(F.any_value("row").alias("row")).select("row"))
    return kept.unionByName(again).select("row.*")
