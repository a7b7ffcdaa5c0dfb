"""BPE encoding and decoding through a distinct-word table.

Encoding. Texts are cut into blocks (a bounded number of bytes of one
partition) and split into words at white space, across which this tokenizer
never merges. A block's distinct words are numbered; its documents become lists
of those numbers. The words of all blocks are dealt by a hash of the word into
parts of the distinct-word table, where each distinct word is encoded once, by
the tokenizers library. Its ids go back to (block, number), and the documents
read them there by position. Only packed words, ids and numbers are shuffled,
never texts; frequent words occur once per block, so none is hot.

A block is named by a hash of its texts. The two passes over the documents
(words, numbers) therefore meet even if a task is run again elsewhere; were a
source to return its rows in another order the second time, the words of a block
would be missing, which stops the job rather than giving a wrong result.

Decoding joins ids to pieces, a table with the tokenizer's fixed vocabulary
(its size is checked), batch by batch, and puts the pieces together.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a block. A larger text is a block by itself.
BLOCK_BYTES = 12 << 20
MOST_PIECES = 2_000_000
#: Parts of the word table per shuffle partition, and the words that a task
#: remembers: with more distinct words to a partition (too few partitions for the
#: data) it forgets and encodes anew, which costs time but changes nothing.
PARTS, MEMORY_WORDS = 4, 1_000_000
#: Words given to the library at once: what it returns for a word is far larger than its ids.
ENCODED_AT_ONCE = 2048


def tokenizer_json(path: str) -> str:
    """The tokenizer file's content; read once on the driver and sent to the
    tasks, so that executors need no file of their own."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenizer(content: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return t


def check(content: str) -> None:
    """Raise unless words may be encoded apart: a BPE whose splitting drops
    white space, without added tokens that hold some."""
    made = json.loads(content)
    tokens = [x["content"] for x in made["added_tokens"]]
    probe = _tokenizer(content)
    one = probe.encode("a b", add_special_tokens=False).ids
    two = [*probe.encode("a", add_special_tokens=False).ids, *probe.encode("b", add_special_tokens=False).ids]
    if made["model"]["type"] != "BPE" or one != two or any(set(common.SPACES) & set(t) for t in tokens):
        raise ValueError("this tokenizer's words depend on the white space around them")


def pieces_of(content: str) -> pa.Array:
    """The id-to-piece table: pieces by id (null where no piece has the id)."""
    vocabulary = _tokenizer(content).get_vocab(with_added_tokens=True)
    size = max(vocabulary.values(), default=-1) + 1
    if size > MOST_PIECES:
        raise ValueError(f"a vocabulary of {size} pieces; at most {MOST_PIECES} can be sent to every task")
    pieces: list = [None] * size
    for piece, i in vocabulary.items():
        pieces[i] = piece
    return pa.array(pieces, pa.string())


def _blocks(batches, column: str, limit: int):
    """Lists of (batch slice, its texts) with about ``limit`` bytes of text.
    Cut text by text, on text bytes alone, so that the cuts do not depend on
    where Arrow batches end (which the other columns of a row shift)."""
    held, size = [], 0
    for b in common.slices(batches, 64):
        texts = b.column(column).cast(pa.binary()).to_pylist()
        start = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                if i > start:
                    held.append((b.slice(start, i - start), texts[start:i]))
                yield held
                held, size, start = [], 0, i
            size += len(t)
        held.append((b.slice(start), texts[start:]))
    if held:
        yield held


def _numbered(held):
    """(the block's name, its words in the order of their numbers, for each
    slice and text the numbers of its words)."""
    import xxhash
    name = xxhash.xxh3_128()
    number: dict[bytes, int] = {}
    out = []
    for _, texts in held:
        own = []
        for t in texts:
            name.update(len(t).to_bytes(8, "little"))
            name.update(t)
            words = t.split()
            own.append(np.fromiter([number.setdefault(w, len(number)) for w in words], "i4", len(words)))
        out.append(own)
    return name.digest(), number, out


def _shrink(a: np.ndarray) -> bytes:
    """Numbers packed for a shuffle: bytes of equal weight side by side, zstd."""
    import zstandard
    n = np.ascontiguousarray(a.astype("<i4")).view("u1").reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(n.tobytes())


def _grow(b: bytes) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "u1")
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def _word_rows(texts: DataFrame, limit: int, parts: int) -> DataFrame:
    """(part, block, words, numbers): each block's distinct words, by the part
    that a hash of the word falls in."""

    def made(batches):
        import zlib
        for held in _blocks(batches, "text", limit):
            block, number, _ = _numbered(held)
            shares: dict[int, list] = {}
            for w in number:
                shares.setdefault(zlib.crc32(w) % parts, []).append(w)
            for part, words in shares.items():
                words.sort()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.binary()), pa.array([b" ".join(words)], pa.binary()),
                     pa.array([_shrink(np.array([number[w] for w in words]))], pa.binary())],
                    ["part", "block", "words", "numbers"])

    return common.map_arrow(texts, made, "part int, block binary, words binary, numbers binary")


def _encoded_words(rows: DataFrame, content: str, partitions: int) -> DataFrame:
    """(block, numbers, lengths, ids): each distinct word is encoded once, in
    its part of the word table, and its ids sent to its blocks."""

    def encoded(batches):
        t = _tokenizer(content)
        ids_of: dict[bytes, bytes] = {}  # ids as packed 32-bit numbers
        for b in common.slices(batches, 16):
            out: list = [[], [], [], []]
            for block, words, numbers in zip(*(b.column(c).to_pylist() for c in ("block", "words", "numbers"))):
                own = words.split(b" ")
                if len(ids_of) > MEMORY_WORDS:
                    ids_of.clear()
                new = [w for w in own if w not in ids_of]
                for at in range(0, len(new), ENCODED_AT_ONCE):
                    part = new[at:at + ENCODED_AT_ONCE]
                    made = t.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                    ids_of.update((w, np.array(e.ids, "<i4").tobytes()) for w, e in zip(part, made))
                ids = [ids_of[w] for w in own]
                lengths = np.fromiter(map(len, ids), "i4", len(ids)) // 4
                for column, value in zip(out, (block, numbers, _shrink(lengths), _shrink(np.frombuffer(b"".join(ids), "<i4")))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["block", "numbers", "lengths", "ids"])

    dealt = rows.repartition(partitions, "part").drop("part")
    return common.map_arrow(dealt, encoded, "block binary, numbers binary, lengths binary, ids binary")


def encode(documents: DataFrame, content: str, text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row with ``ids`` (array of int) in place of its text: what the
    tokenizers library's ``encode(text, add_special_tokens=False)`` gives for
    the whole text. Null texts count as empty and have no ids. An input column
    ``ids`` is replaced; other columns and repeated rows stay; an empty table
    gives an empty result.
    ``documents`` is read twice and must return its rows in the same order
    (module docstring): pass a table, not a shuffled frame."""
    check(content)
    rest = [c for c in documents.columns if c != "ids"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in rest if c != text_column]).alias("row") if rest != [text_column]
                            else F.struct(F.lit(0).alias("_")).alias("row"),
                            common.text_of(text_column).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _encoded_words(_word_rows(rows.select("text"), block_bytes, PARTS * parts), content, parts)

    def numbered(batches):
        for held in _blocks(batches, "text", block_bytes):
            block, number, numbers = _numbered(held)
            for (b, texts), own in zip(held, numbers):
                # a slice of documents to a row: long runs of numbers pack well
                lengths = np.array([len(n) for n in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), b.column("row")),
                     pa.array([_shrink(np.concatenate(own))], pa.binary()), pa.array([_shrink(lengths)], pa.binary()),
                     pa.array([len(number)], pa.int64())],
                    ["block", "rows", "numbers", "lengths", "words"])

    def joined(batches):
        # sorted by block, its words' ids first: one block's ids are held at a time
        now, parts_held, table = None, [], None
        for b in common.slices(batches, 16):
            for i, (block, is_doc) in enumerate(zip(b.column("block").to_pylist(), b.column("is_doc").to_pylist())):
                if block != now:
                    now, parts_held, table = block, [], None
                numbers, lengths = (_grow(b.column(c)[i].as_py()) for c in ("numbers", "lengths"))
                if not is_doc:
                    parts_held.append([numbers, lengths, _grow(b.column("ids")[i].as_py())])
                    continue
                if table is None:
                    table = _by_number(parts_held, b.column("words")[i].as_py())
                    parts_held = []
                ids, of_word = _ids(table, numbers), table[2][numbers]
                ends = np.concatenate([[0], np.cumsum(of_word)])[np.concatenate([[0], np.cumsum(lengths)])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rows")[i].values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
                    ["row", "ids"])

    docs = common.map_arrow(rows.select("row", "text"), numbered, f"block binary, rows array<{kind}>, numbers binary, lengths binary, words long")
    none = F.lit(None)
    both = (words.select("block", F.lit(False).alias("is_doc"), none.cast(f"array<{kind}>").alias("rows"), "numbers", "lengths",
                           none.cast("long").alias("words"), "ids")
            .unionAll(docs.select("block", F.lit(True).alias("is_doc"), "rows", "numbers", "lengths", "words", none.cast("binary").alias("ids"))))
    met = both.repartition(parts, "block").sortWithinPartitions("block", "is_doc")
    out = common.map_arrow(met, joined, f"row {kind}, ids array<int>")
    return out.select(*([] if rest == [text_column] else ["row.*"]), "ids")


def _by_number(parts: list, n_words: int):
    """(ids of all words of a block, first position, length), by number."""
    if not parts and n_words:
        raise RuntimeError("a block's words are missing: the source returned its rows in another order")
    empty = np.zeros(0, "i4")
    numbers, lengths, ids = (np.concatenate([p[k] for p in parts]) if parts else empty for k in range(3))
    # a block with the same texts as another one brings its words twice, with the same ids
    starts = np.cumsum(lengths) - lengths
    first, length = np.full(n_words, -1, "i8"), np.zeros(n_words, "i8")
    first[numbers], length[numbers] = starts, lengths
    if (first < 0).any():
        raise RuntimeError("words of a block are missing: the source returned its rows in another order")
    return ids, first, length


def _ids(table, numbers: np.ndarray) -> np.ndarray:
    ids, first, length = table
    n = length[numbers]
    total = int(n.sum())
    within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return ids[np.repeat(first[numbers], n) + within]


def decode(encoded: DataFrame, content: str, ids_column: str = "ids", out_column: str = "decoded") -> DataFrame:
    """Every row with the text of its ids, as the library's ``decode(ids,
    skip_special_tokens=False)`` gives it for a tokenizer without a decoder:
    the pieces with a space between. Ids without a piece are left out; null
    ids give an empty text; an input column of the output's name is replaced.
    Repeated rows stay; an empty table gives an empty result."""
    if json.loads(content).get("decoder"):
        raise ValueError("only for tokenizers without a decoder")
    pieces = pieces_of(content)
    rest = [c for c in encoded.columns if c != out_column]
    inner = encoded.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    kind = inner.schema["row"].dataType.simpleString()
    place = rest.index(ids_column)

    def joined(batches):
        for b in common.slices(batches, 512):
            # null ids have length 0 here; slices carry their offsets through flatten()
            ids = pc.struct_field(b.column("row"), place)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(pieces))
            found = pieces.take(pa.array(np.where(known, flat, 0), pa.int32()))
            known &= found.is_valid().to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(known)])  # pieces kept before each id
            ends = before[np.concatenate([[0], np.cumsum(lengths)])]
            kept = found if known.all() else found.filter(pa.array(known))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept)
            yield pa.RecordBatch.from_arrays([b.column("row"), pc.binary_join(lists, " ")], ["row", out_column])

    return common.map_arrow(inner, joined, f"row {kind}, {out_column} string").select("row.*", out_column)
