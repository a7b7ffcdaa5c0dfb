"""Periodic runs: passages in which the same words come again and again.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``powers`` periods and ``least`` words long, that no
neighbouring word extends. They are found with a dictionary of basic factors:
for L = 1, 2, 4, ... every factor of L words gets a name, made of the names of
its two halves. The successor of a factor is the next place of the same name.
Successors at a distance up to 2 L chain into arithmetic progressions. Where
the distance q is over L / 2 and at most L (smaller ones belong to the levels
before, larger ones to the next), a factor holds a whole period, so that inside
a run every successor is exactly one period away: a stretch of consecutive
places with the same distance q proposes the run, which is then extended word
by word on both sides, and proposals of one (start, period) are one run.

Names are kept only for places whose factor occurs again in the same text, so
that the levels beyond a few words cost next to nothing in ordinary prose. Texts
are handled in blocks, several short texts at once; a long text's words are read
a piece at a time and held as one number each.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, LEAST_POWERS = 24, 3
#: Words of texts handled together, and bytes of a text split at once.
BLOCK_WORDS, PIECE = 500_000, 1 << 20

_SPACES = frozenset(common.SPACES.encode())


def numbers(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words' numbers in ``known``, a dictionary that numbers new words."""
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        out.append(np.fromiter(map(known.__getitem__, text[at:end].split()), "i8"))
        at = end
    return np.concatenate(out) if out else np.zeros(0, "i8")


def _named(key: np.ndarray, place: np.ndarray):
    """(number, next place of the same key or -1, occurs again or before) for
    each place; places ascend."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    name, found, again = np.empty(len(key), "i8"), np.full(len(key), -1, "i8"), np.zeros(len(key), bool)
    name[order] = np.cumsum(np.r_[False, ~same])[:len(key)]
    before, after = order[:-1][same], order[1:][same]
    found[before] = place[after]
    again[before] = again[after] = True
    return name, found, again


def _extended(words: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, q: np.ndarray):
    """Stretches [first, last) made as long as words q apart stay identical
    inside one text."""
    n = len(words)
    for step, edge in ((-1, first), (1, last)):
        going = np.arange(len(edge))
        while len(going):
            # the new word and the one q away from it, inside the stretch
            new = edge[going] - 1 if step < 0 else edge[going]
            other = new + q[going] if step < 0 else new - q[going]
            ok = (new >= 0) & (new < n)
            a, b = np.clip(new, 0, n - 1), np.clip(other, 0, n - 1)
            ok &= (text[a] == text[b]) & (words[a] == words[b])
            going = going[ok]
            edge[going] += step
    return first, last


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.
    ``words`` are numbers, ``text`` the number of the text that each word
    belongs to (ascending; no run crosses texts). ``powers`` is 3 or more: a
    run then shows its period wherever a factor that holds it repeats."""
    place, length, made = np.arange(len(words), dtype="i8"), 1, []
    # one key for each (text, word): places of different texts never meet
    name, found, again = _named(text * (words.max(initial=0) + 1) + words, place)
    while again.any():
        far = found - place
        mine = (found >= 0) & (2 * far > length) & (far <= length)
        at, q = place[mine], far[mine]
        if len(at):
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (q[1:] != q[:-1])])
            ends = np.r_[starts[1:], len(at)] - 1
            first, last, period = at[starts], at[ends] + length + q[starts], q[starts]
            ok = last - first >= powers * period
            made.append(np.stack([*_extended(words, text, first[ok], last[ok], period[ok]), period[ok]], 1))
        # the next level: two halves side by side, both of which occur again
        place, name = place[again], name[again]
        right = np.searchsorted(place, place + length)
        whole = np.flatnonzero(place[np.minimum(right, len(place) - 1)] == place + length)
        key = name[whole] * (name.max() + 1) + name[right[whole]]
        place, length = place[whole], 2 * length
        name, found, again = _named(key, place)
    if not made:
        return np.zeros((0, 3), "i8")
    out = np.unique(np.concatenate(made), axis=0)
    out[:, 1] -= out[:, 0]
    out = out[out[:, 1] >= np.maximum(least, powers * out[:, 2])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: not those in a run after its first period."""
    cover = np.zeros(n + 1, "i8")
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return cover[:n].cumsum() == 0


def blocks(texts: list[bytes]):
    """(positions of a block's texts, their words' numbers, the words by
    number), with about ``BLOCK_WORDS`` words to a block."""
    own, held, size, known = [], [], 0, defaultdict(count().__next__)
    for i, t in enumerate(texts):
        own.append(i)
        held.append(numbers(t, known))
        size += len(held[-1])
        if size >= BLOCK_WORDS or i == len(texts) - 1:
            yield own, held, list(known)
            own, held, size, known = [], [], 0, defaultdict(count().__next__)


def collapse(texts: list[bytes], least: int = LEAST_WORDS, powers: int = LEAST_POWERS):
    """(number of words, runs, collapsed text) of each text."""
    for own, held, spelled in blocks(texts):
        sizes = np.array([len(x) for x in held])
        starts = np.cumsum(sizes) - sizes
        every = runs(np.concatenate(held), np.repeat(np.arange(len(own)), sizes), least, powers)
        # the last text that begins at a run's start: texts without words begin there, too
        of = np.searchsorted(starts, every[:, 0], side="right") - 1
        for k, x in enumerate(held):
            found = every[of == k] - [starts[k], 0, 0] if len(every) else every
            left = x[kept_words(len(x), found)] if len(found) else x
            yield len(x), found, b" ".join(map(spelled.__getitem__, left.tolist()))


def find(documents: DataFrame, text_column: str = "text", least: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> DataFrame:
    """Every row, without its text, with ``n_words`` (long), ``runs`` (array of
    start, length, period, by start, then period; word numbers from 0) and
    ``collapsed``: the words that no run drops (a run drops what follows its
    first period), joined by one space. Input columns of these names are
    replaced, the other columns stay.

    Null and blank texts have no words, no runs and an empty collapsed text.
    Repeated rows are handled each for itself; an empty table gives an empty
    result. A text of any length is handled whole, in one task; a task holds
    the words of about ``BLOCK_WORDS`` words of texts or of one longer text."""
    made = ["n_words", "runs", "collapsed"]
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in made and c != text_column]
    inner = documents.select(F.struct(*(rest or [F.lit(0).alias("_")])).alias("row"), common.text_of(text_column).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batches):
        for b in common.slices(batches, 256):
            each = list(collapse(b.column("text").cast(pa.binary()).to_pylist(), least, powers))
            listed = [[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for _, r, _ in each]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([n for n, _, _ in each], pa.int64()), pa.array(listed, kind),
                 pa.array([t for _, _, t in each], pa.binary()).cast(pa.string())], ["row", *made])

    schema = (f"row {inner.schema['row'].dataType.simpleString()}, n_words long, "
              "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    out = common.map_arrow(inner, found, schema)
    return out.select(*(["row.*"] if rest else []), *made)


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the
    smallest start, then period; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(found, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listed(found: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
