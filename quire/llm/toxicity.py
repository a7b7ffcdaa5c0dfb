"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased runs of letters and digits) get hashed embeddings: the sum
of three rows of one table, chosen by two hashes of the word and one of its
prefix, so that two different words rarely share all rows and inflected forms
share one. Filters of widths 1, 2 and 3 run over the word vectors; each filter's
largest value over the whole text (max pooling) goes to a logistic output.

Training: every labelled row outside the held-out fold, whole texts, turned into
hashes on the executors and dealt by a hash of the id into shards of about
``SHARD_CHARS`` characters. A pass goes over all shards at once: each goes on
from the merged model by Adagrad on its own rows, and the shards' models are
merged on the executors, every value as the mean of the shards that moved it.
A corpus of one shard makes its ``EPOCHS`` passes in one task, without merging;
with more shards there are ``MERGED_PASSES``. The driver holds models only,
whose size is fixed. Scoring maps the whole text of every document, in blocks
of words, on the executors.

Thresholds: for each language with enough labelled rows, the threshold with the
best F1 on all labelled rows, held to ``THRESHOLD_RANGE``; 0.5 for others. Each
row is scored for this by a model fitted without its part of the rows, and only
counts by language and grid step leave the executors. The language sets the
threshold only; it is no input of the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A shard's size: about 4,000 texts of so many words.
SAMPLE_WORDS = 600
SHARD_CHARS = 4_000 * SAMPLE_WORDS * 7
#: Characters that a row counts for at least.
ROW_CHARS = 100
#: Labelled ids up to this number are broadcast.
BROADCAST_IDS = 2_000_000
#: Each shard's parts that are left out in turn to set the thresholds.
CALIBRATION_FOLDS = 2
TABLE_BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 5
MERGED_PASSES = 3
#: A table travels in so many blocks.
BLOCKS = 8
PREFIX = 4
RATE = 0.1
#: The small parameters, beside the table and the output's bias.
DENSE = ("taps", "bias", "out")
THRESHOLD_RANGE = (0.3, 0.7)
GRID = np.linspace(*THRESHOLD_RANGE, 41)
#: Labelled rows of each class that a language needs for a threshold of its own.
THRESHOLD_ROWS = 20
#: Words of one text handled at once when scoring, and words remembered with their vectors.
BLOCK_WORDS = 65_536
MEMORY_WORDS = 200_000

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def rows_of(word: str) -> tuple[int, int, int]:
    """The three rows of the embedding table that make up a word."""
    import xxhash
    whole = xxhash.xxh64_intdigest(word, 1)
    prefix = xxhash.xxh64_intdigest("^" + word[:PREFIX], 2)
    mask = (1 << TABLE_BITS) - 1
    return whole & mask, (whole >> 32) & mask, prefix & mask


def sum_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The vectors of words, given by their three rows."""
    return table[rows[:, 0]] + table[rows[:, 1]] + table[rows[:, 2]]


@dataclass
class Model:
    """Embedding table; filters as one matrix (dim x all taps); output weights."""
    table: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text; texts begin at ``starts``
        and have at least one word. Windows that cross a text's end see zeros
        there."""
        return self.pooled_at(vectors, starts)[0]

    def pooled_at(self, vectors, starts):
        n = len(vectors)
        ends = np.append(starts[1:], n)
        products = vectors @ self.taps
        out, values = [], []
        at = 0
        for k, width in enumerate(WIDTHS):
            total = products[:, at:at + FILTERS].copy()
            for tap in range(1, width):
                part = products[tap:, at + tap * FILTERS:at + (tap + 1) * FILTERS]
                # the last places of each text, whose windows end outside it, keep their value
                last = np.concatenate([np.maximum(ends - back, starts) for back in range(1, tap + 1)])
                kept = total[last]
                total[:n - tap] += part[:max(0, n - tap)]
                total[last] = kept
            at += width * FILTERS
            values.append(total)
            out.append(np.maximum.reduceat(total, starts, axis=0))
        return np.concatenate(out, 1), values

    def largest(self, texts: list[np.ndarray]):
        """(largest value of each filter in each text, the position of its
        window); texts as embedding rows, each with at least one word, and
        handled in blocks of at most ``BLOCK_WORDS`` words."""
        n_out, overlap = len(self.bias), max(WIDTHS) - 1
        pooled, best = np.full((len(texts), n_out), -np.inf, "f4"), np.zeros((len(texts), n_out), "i8")
        pending, held = [], 0

        def flush():
            nonlocal pending, held
            if pending:
                parts = [texts[i][at:at + n] for i, at, n, _ in pending]
                starts = np.cumsum([0] + [len(x) for x in parts[:-1]])
                _, values = self.pooled_at(sum_of(self.table, np.concatenate(parts)), starts)
                values = np.concatenate(values, 1)
                for s, (i, at, _, own) in zip(starts, pending):
                    where = values[s:s + own].argmax(0)
                    found = values[s + where, np.arange(n_out)]
                    more = found > pooled[i]
                    pooled[i, more], best[i, more] = found[more], at + where[more]
            pending, held = [], 0

        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                # a window belongs to the block that holds it whole
                n = min(BLOCK_WORDS, len(t) - at)
                last = at + n == len(t)
                if held + n > BLOCK_WORDS:
                    flush()
                pending.append((i, at, n, n if last else n - overlap))
                held += n
                at = len(t) if last else at + n - overlap
        flush()
        return pooled, best

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def started(rng) -> tuple[Model, dict]:
    """(a random model, its Adagrad state). Every filter begins as a sign of
    toxicity (a positive output weight): the largest of many windows says what
    a text holds, hardly what it lacks."""
    n_out = FILTERS * len(WIDTHS)
    m = Model(rng.normal(0, .05, (1 << TABLE_BITS, DIM)).astype("f4"), rng.normal(0, .3, (DIM, FILTERS * sum(WIDTHS))).astype("f4"),
              np.zeros(n_out, "f4"), np.abs(rng.normal(0, .3, n_out)).astype("f4"), 0.0)
    return m, {**{k: np.full_like(getattr(m, k), 1e-4) for k in ("table", *DENSE)}, "out_bias": 1e-4}


def constant(m: Model, ones: int, n: int) -> None:
    """One class only, or no text: the class's share, whatever the text (below
    0.5 without labels)."""
    m.out[:] = 0
    share = (float(ones) + 0.5) / (n + 2)
    m.out_bias = float(np.log(share / (1 - share)))


def weights(y: np.ndarray, share) -> np.ndarray:
    """Both classes weigh the same; ``share`` is the ones' among all rows."""
    return np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype("f4")


def one_pass(m: Model, state: dict, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
    """Adagrad on batches of whole texts, in ``order``; model and state change
    in place."""
    tap_at = np.concatenate([[0], np.cumsum([w * FILTERS for w in WIDTHS])])
    for at in range(0, len(order), 64):
        own = order[at:at + 64]
        pooled, best = m.largest([texts[i] for i in own])
        active = np.maximum(pooled + m.bias, 0)
        error = (sigmoid(active @ m.out + m.out_bias) - y[own]) * weight[own] / len(own)
        grad_hidden = error[:, None] * m.out * (pooled + m.bias > 0)
        grads = {"out": active.T @ error + 1e-4 * m.out, "bias": grad_hidden.sum(0), "taps": np.zeros_like(m.taps)}
        touched, grad_rows = [], []
        words, lengths = np.concatenate([texts[i] for i in own]), np.array([len(texts[i]) for i in own])
        starts = np.cumsum(lengths) - lengths
        for k, width in enumerate(WIDTHS):
            # by text, tap and filter: the words of the windows that gave the largest values
            g = grad_hidden[:, None, k * FILTERS:(k + 1) * FILTERS]
            place = best[:, None, k * FILTERS:(k + 1) * FILTERS] + np.arange(width)[:, None]
            d, tap, f = np.nonzero((place < lengths[:, None, None]) & (g != 0))
            if len(d):
                rows, cols, g = words[starts[d] + place[d, tap, f]], tap_at[k] + tap * FILTERS + f, g[d, 0, f][:, None]
                np.add.at(grads["taps"].T, cols, sum_of(m.table, rows) * g)
                touched.append(rows)
                grad_rows.append(g * m.taps[:, cols].T)
        for name, g in grads.items():
            state[name] += g * g
            setattr(m, name, getattr(m, name) - RATE * g / np.sqrt(state[name]))
        g = float(error.sum())
        state["out_bias"] += g * g
        m.out_bias -= RATE * g / state["out_bias"] ** 0.5
        if touched:
            which = np.concatenate(touched).ravel()
            g = np.repeat(np.concatenate(grad_rows), 3, axis=0)
            unique, inverse = np.unique(which, return_inverse=True)
            summed = np.zeros((len(unique), DIM), "f4")
            np.add.at(summed, inverse, g)
            state["table"][unique] += summed ** 2
            m.table[unique] -= RATE * summed / np.sqrt(state["table"][unique])


def settle(m: Model, state: dict) -> None:
    """A word never trained on says nothing: only rows that moved keep their vector."""
    m.table[(state["table"] <= 1.0001e-4).all(1)] = 0


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int = 0) -> Model:
    """The model of texts in memory. ``texts``: the embedding rows of each
    text's words, (words, 3)."""
    rng = np.random.default_rng(seed)
    m, state = started(rng)
    keep = [i for i, t in enumerate(texts) if len(t)]
    y = y.astype("f4")
    if not keep or len(set(y[keep].tolist())) < 2:
        constant(m, y.sum(), len(y))
        return m
    weight = weights(y, y.mean())
    for _ in range(EPOCHS):
        one_pass(m, state, texts, y, weight, rng.permutation(keep))
    settle(m, state)
    return m


def score_sample(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        pooled = model.largest([t])[0][0] if len(t) else np.zeros(len(model.bias))
        out[i] = sigmoid(model.logit(pooled[None])[0])
    return out


def left_out(texts: list[np.ndarray], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the k-th part of texts in memory, their scores by a model
    fitted without it)."""
    own, outside = inside(len(texts), k + 1), np.arange(k, len(texts), CALIBRATION_FOLDS)
    return outside, score_sample(fit([texts[i] for i in own], y[own]), [texts[i] for i in outside])


def left_out_scores(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Each text's score by a model fitted without its part of the texts."""
    out = np.empty(len(texts))
    for k in range(CALIBRATION_FOLDS):
        at, scores = left_out(texts, y, k)
        out[at] = scores
    return out


def best_threshold(above: np.ndarray, ones: int) -> float:
    """The threshold with the best F1 (the middle of equally good ones);
    ``above``: how many ones and zeros score at least each grid step, (steps, 2)."""
    f1 = np.array([2 * hit / max(1, hit + false + ones) for hit, false in above])
    return float(np.median(GRID[f1 == f1.max()]))


def thresholds(scored: DataFrame) -> dict[str, float]:
    """For each language the best threshold. ``scored``: (lang, y, step), step
    being the number of grid values that the row's score reaches. Only counts
    of languages with enough rows of both classes reach the driver."""
    n = scored.groupBy("lang").agg(*[F.count_if(F.col("y") == y).alias(f"n{y}") for y in (0, 1)])
    n = n.where(f"n0 >= {THRESHOLD_ROWS} and n1 >= {THRESHOLD_ROWS}").select("lang")
    steps = scored.groupBy("lang", "step").agg(*[F.count_if(F.col("y") == y).alias(f"n{y}") for y in (0, 1)])
    each = F.array_sort(F.collect_list(F.struct("step", "n1", "n0"))).alias("steps")
    out = {}
    for r in steps.join(n, "lang").groupBy("lang").agg(each).collect():
        counts = np.zeros((len(GRID) + 1, 2), "i8")
        for step, ones, zeros in r["steps"]:
            counts[step] = ones, zeros
        above = counts[::-1].cumsum(0)[::-1]  # rows that reach at least so many grid values
        out[r["lang"]] = best_threshold(above[1:], int(above[0, 0]))
    return out


def hashed_rows(documents: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(shard, id, lang, y, rows): every labelled document once, its words'
    embedding rows packed, each shard whole in one partition and in the order
    of the ids. Texts are shuffled, once: they take less than their hashes."""
    columns = ["shard", "id", "lang", "y", "rows"]

    def hashed(batches):
        import zstandard
        pack, seen = zstandard.ZstdCompressor(level=1), {}

        def packed(text):
            words = words_of(text)
            if len(seen) > MEMORY_WORDS:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = rows_of(w)
            return pack.compress(np.array([seen[w] for w in words], "i4").tobytes())

        def batch(found):
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], columns)

        found = []
        for b in common.slices(batches, 256):
            for *head, text in zip(*(b.column(c).to_pylist() for c in (*columns[:-1], "_text"))):
                row = (*head, packed(text))
                if not found or found[-1][1] != row[1]:
                    found.append(row)
                elif found[-1][:4] == row[:4]:  # an id's first row has its smallest language
                    found[-1] = min(found[-1], row, key=lambda r: r[4])
            if len(found) > 1:  # the last id may go on
                yield batch(found[:-1])
                found = found[-1:]
        if found:
            yield batch(found)

    joined = documents.join(known, "_id").select(F.col("_id").cast("string").alias("id"), "_text", F.col("_lang").alias("lang"), F.col("_y").alias("y"))
    dealt = joined.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(2 * shards - 1, "shard")
    return common.map_arrow(dealt.sortWithinPartitions("shard", "id", "lang", "y"), hashed, "shard int, id string, lang string, y int, rows binary")


def shards_of(batches):
    """(shard, texts, labels, languages) of each shard in a partition."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    now, texts, y, langs = None, [], [], []
    for b in common.slices(batches, 256):
        for shard, packed, label, lang in zip(*(b.column(c).to_pylist() for c in ("shard", "rows", "y", "lang"))):
            if shard != now:
                if texts:
                    yield now, texts, np.array(y, "f4"), langs
                now, texts, y, langs = shard, [], [], []
            texts.append(np.frombuffer(unpack.decompress(packed), "i4").reshape(-1, 3))
            y.append(label)
            langs.append(lang)
    if texts:
        yield now, texts, np.array(y, "f4"), langs


def inside(n: int, k: int) -> np.ndarray:
    """Positions of a shard's rows that the k-th fit learns from: fit 0 from
    all, the others without a part."""
    return np.flatnonzero(np.arange(n) % CALIBRATION_FOLDS != k - 1)


def class_counts(rows: DataFrame) -> dict:
    """By fit: rows, ones, and rows with a word of each class."""
    names = ("n", "ones", "words0", "words1")

    def counted(batches):
        for _, texts, y, _ in shards_of(batches):
            some = np.array([len(t) > 0 for t in texts])
            for k in range(CALIBRATION_FOLDS + 1):
                at = inside(len(y), k)
                found = [len(at), int(y[at].sum()), *(int((some[at] & (y[at] == c)).sum()) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, *found)], ["fit", *names])

    each = common.map_arrow(rows, counted, "fit long, n long, ones long, words0 long, words1 long")
    return {r["fit"]: r for r in each.groupBy("fit").agg(*[F.sum(c).alias(c) for c in names]).collect()}


def dense_of(m: Model, state: dict) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([*(np.ravel(p[k]) for k in DENSE), [p["out_bias"]]]).astype("f8") for p in (vars(m), state))


def merged_pass(rows: DataFrame, fit: int, before: list[dict] | None, share, shards: int, turn: int, seed: int = 0) -> DataFrame:
    """(block, at, value, state): the model of a fit after a pass of all
    shards, only the table rows that moved, by blocks of the table; block
    ``BLOCKS`` holds the small parameters. ``before``: what had moved
    before the pass (``sparse``), None at the first; the seed makes the rest. ``share``:
    the ones' among the fit's rows."""
    size = (1 << TABLE_BITS) // BLOCKS
    passes, blocks, schema = EPOCHS if shards == 1 else 1, BLOCKS, ["block", "shard", "at", "value", "state"]

    def trained(batches):
        for shard, texts, y, _ in shards_of(batches):
            own = [i for i in inside(len(y), fit) if len(texts[i])]
            if not own:
                continue
            rng = np.random.default_rng(seed)
            m, state = started(rng)
            for r in before or ():
                take_in(m, state, r)
            if shards > 1:
                rng = np.random.default_rng([seed, turn, shard])
            old = state["table"].copy()
            weight = weights(y, share)
            for _ in range(passes):
                one_pass(m, state, texts, y, weight, rng.permutation(own))
            moved = (state["table"] != old).any(1)
            for block in range(blocks + 1):
                if block < blocks:
                    at = np.flatnonzero(moved[block * size:(block + 1) * size])
                    value, grown = (x[block * size + at] for x in (m.table, state["table"]))
                else:
                    value, grown = dense_of(m, state)
                    at = np.arange(len(value))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (block, shard)]
                                                 + [pa.array([x.tobytes()], pa.binary()) for x in (at.astype("i4"), value, grown)], schema)

    def merged(batches):
        # sorted: the shards of one block come one after the other
        now, held = None, None

        def mean():
            at = np.flatnonzero(held[0])
            kind = "f8" if now == blocks else "f4"
            cells = [at.astype("i4").tobytes(), *((x[at] / held[0][at, None]).astype(kind).tobytes() for x in held[1:])]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())] + [pa.array([x], pa.binary()) for x in cells],
                                              ["block", "at", "value", "state"])

        for b in common.slices(batches, 1):
            block, at, value, state = (b.column(c)[0].as_py() for c in ("block", "at", "value", "state"))
            if block != now:
                if now is not None:
                    yield mean()
                now, held = block, [np.zeros(size, "i4"), *(np.zeros((size, 1 if block == blocks else DIM)) for _ in "vs")]
            at = np.frombuffer(at, "i4")
            held[0][at] += 1
            for total, x in zip(held[1:], (value, state)):
                total[at] += np.frombuffer(x, "f8" if block == blocks else "f4").reshape(len(at), -1)
        if now is not None:
            yield mean()

    each = common.map_arrow(rows, trained, "block int, shard int, at binary, value binary, state binary")
    met = each.repartition(BLOCKS + 1, "block").sortWithinPartitions("block", "shard")
    return common.map_arrow(met, merged, "block int, at binary, value binary, state binary")


def fitted(rows: DataFrame, fit: int, counts, shards: int) -> Model:
    """The model of one fit over all shards; ``counts``: its ``class_counts``."""
    m, state = started(np.random.default_rng(0))  # as the shards begin
    if counts is None or not (counts["words0"] and counts["words1"]):
        constant(m, counts["ones"] if counts else 0, counts["n"] if counts else 0)
        return m
    share = np.float32(counts["ones"]) / np.float32(counts["n"])
    for turn in range(1 if shards == 1 else MERGED_PASSES):
        for r in merged_pass(rows, fit, sparse(m, state) if turn else None, share, shards, turn).collect():
            take_in(m, state, r)
    settle(m, state)
    return m


def sparse(m: Model, state: dict) -> list[dict]:
    """What moved since the start, as rows that ``take_in`` reads; far smaller
    than the model, which every task gets."""
    at = np.flatnonzero((state["table"] != np.float32(1e-4)).any(1))
    dense = dense_of(m, state)
    return [{"block": 0, "at": at.astype("i4").tobytes(), "value": m.table[at].tobytes(), "state": state["table"][at].tobytes()},
            {"block": BLOCKS, "at": b"", "value": dense[0].tobytes(), "state": dense[1].tobytes()}]


def take_in(m: Model, state: dict, row) -> None:
    """A merged block becomes part of the model and its state."""
    at, block = np.frombuffer(row["at"], "i4"), row["block"]
    if block < BLOCKS:
        at = at + block * ((1 << TABLE_BITS) // BLOCKS)
        m.table[at], state["table"][at] = (np.frombuffer(row[c], "f4").reshape(-1, DIM) for c in ("value", "state"))
        return
    ends = np.cumsum([getattr(m, k).size for k in DENSE])
    for c, put in (("value", lambda k, v: setattr(m, k, v)), ("state", state.__setitem__)):
        flat = np.frombuffer(row[c], "f8")
        for k, v in zip(DENSE, np.split(flat[:ends[-1]], ends[:-1])):
            put(k, v.astype("f4").reshape(getattr(m, k).shape))
        put("out_bias", float(flat[-1]))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id",
          text_column: str = "text", lang_column: str | None = "lang") -> Model:
    """Fit the classifier on all labelled rows outside the held-out fold
    (module docstring). No labels, or one class only: a model that scores every
    text alike. Of a repeated id the smallest row (language, hashes) counts."""
    known = common.labelled(labels, label)
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    lang = F.col(lang_column) if lang_column and lang_column in documents.columns else F.lit(None)
    docs = documents.select(F.col(id_column).alias("_id"), common.text_of(text_column).alias("_text"),
                            lang.cast("string").alias("_lang"))
    chars = docs.join(known, "_id").agg(F.sum(F.greatest(F.length("_text"), F.lit(ROW_CHARS)))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    with common.shuffles_dropped(documents.sparkSession):
        # each pass reads the hashes again, with their shards in place
        rows = hashed_rows(docs, known, shards).persist(StorageLevel.DISK_ONLY)
        try:
            counts = class_counts(rows)
            model, *without = (fitted(rows, k, counts.get(k), shards) for k in range(CALIBRATION_FOLDS + 1))

            def left_out_steps(batches):
                for _, texts, y, langs in shards_of(batches):
                    scores = np.empty(len(y))
                    for k, m in enumerate(without):
                        at = np.arange(k, len(y), CALIBRATION_FOLDS)
                        scores[at] = score_sample(m, [texts[i] for i in at])
                    steps = np.searchsorted(GRID, scores, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in langs]), pa.array(y.astype("i4")), pa.array(steps, pa.int32())],
                                                     ["lang", "y", "step"])

            # computed once: the counts by language and the counts by step read it
            scored = common.written(common.map_arrow(rows, left_out_steps, "lang string, y int, step int"), "toxicity-steps")
            model.thresholds = thresholds(scored)
        finally:
            rows.unpersist()
    return model


class Scorer:
    """Scores whole texts; remembers the vectors of a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.vectors = np.zeros((MEMORY_WORDS + 2 * BLOCK_WORDS, DIM), "f4")

    def _look_up(self, words: list[str]) -> np.ndarray:
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if len(index) + len(new) > MEMORY_WORDS:
            index.clear()
            new = list(dict.fromkeys(words))
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new))))
            rows = np.array([rows_of(w) for w in new], "i4")
            self.vectors[at:at + len(new)] = sum_of(self.model.table, rows)
        return self.vectors[np.fromiter(map(index.__getitem__, words), "i4", len(words))]

    def __call__(self, texts: list[str]) -> np.ndarray:
        pooled = np.full((len(texts), len(self.model.bias)), -np.inf, "f4")
        pending, spans, held = [], [], 0

        def flush():
            nonlocal pending, spans, held
            if pending:
                starts = np.cumsum([0] + [len(p) for p in pending[:-1]])
                found = self.model.pooled(self._look_up([w for p in pending for w in p]), starts)
                np.maximum.at(pooled, np.array(spans), found)
            pending, spans, held = [], [], 0

        overlap = max(WIDTHS) - 1
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                pooled[i] = 0
            at = 0
            while at < len(words):
                # blocks of a long text overlap, so no window is lost at their edge
                part = words[at:at + BLOCK_WORDS]
                if held + len(part) > BLOCK_WORDS:
                    flush()
                pending.append(part)
                spans.append(i)
                held += len(part)
                if at + len(part) >= len(words):
                    break
                at += BLOCK_WORDS - overlap
        flush()
        return sigmoid(self.model.logit(pooled).astype("f8"))


def score(documents: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Every row with ``score`` (double, 0 to 1), ``predicted`` (1 if score >=
    0.5), ``threshold`` (of the row's language) and ``rejected`` (score >=
    threshold). Input columns of these names are replaced. Null texts count as
    empty; empty texts get the score of a text without words. Rows are kept as
    they are, repeated ones too; an empty table gives an empty result."""
    made = ["score", "predicted", "threshold", "rejected"]
    rest = [c for c in documents.columns if c not in made]
    lang = F.col(lang_column).cast("string") if lang_column in documents.columns else F.lit(None).cast("string")
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
                             common.text_of(text_column).alias("text"), lang.alias("lang"))

    def scored(batches):
        scorer = Scorer(model)
        for b in common.slices(batches, 512):
            s = scorer(b.column("text").to_pylist())
            limit = np.array([model.thresholds.get(str(x), 0.5) for x in b.column("lang").to_pylist()], "f8")
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(s), pa.array((s >= 0.5).astype("i4")), pa.array(limit), pa.array(s >= limit)],
                ["row", *made])

    kind = inner.schema["row"].dataType.simpleString()
    out = common.map_arrow(inner, scored, f"row {kind}, score double, predicted int, threshold double, rejected boolean")
    return out.select("row.*", *made)
