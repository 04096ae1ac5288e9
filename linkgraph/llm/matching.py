"""Free spellings mapped to the entries of a canonical list.

The distinct values are normalised and looked up in an inverted index of character grams (single
characters, neighbours, and neighbours but one) of the entries. Candidates are scored by the cosine
of their grams, weighted by rarity among the entries; the best one is accepted if its cosine
reaches THRESHOLD and leads the second best by MARGIN.

The index lies in blocks of the list, each built in the tasks that search it; values meet every
block. The search is exact: a value's grams are taken in the order of their rarity, and those after
which the rest can't reach the cosine that matters any more yield no candidates (prefix filter), on
the side of the values and of the entries alike.
"""

from __future__ import annotations

import html
import math
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.operators.skew import join_unique
from linkgraph.plans.session import checkpointed, shuffle_width

#: Accepted from this cosine on, with at least this lead over the second best entry.
THRESHOLD, MARGIN = 0.4, 0.08
#: A second best entry matters only above this cosine, so no candidate below it is looked for.
FLOOR = THRESHOLD - MARGIN
#: Entries in a block of the index, values in a task.
BLOCK_ENTRIES, TASK_VALUES = 50_000, 200_000
#: Grams are numbered by hash; the table of their weights has this fixed size whatever the list.
GRAM_BITS = 18
_EDGE = " \t\"'“”„«»‘’:?.,;!"
_AMP, _ANCHOR, _REST = regex.compile("(?i)&amp;"), regex.compile(r"#[^,]*"), regex.compile(r"[^\p{L}\p{M}\p{N}&]")
# Letters that don't decompose.
_TRANSFER = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss"})


def normalise(value: str) -> str:
    """A spelling without what free typing varies: encodings, case, accents, blanks and all other
    signs but letters, digits and ``&``; anchors are cut off."""
    s = html.unescape(_AMP.sub("&", unicodedata.normalize("NFKC", value)))
    s = _ANCHOR.sub("", unquote(s, errors="replace")).replace("_", " ").strip(_EDGE)
    s = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
    return _REST.sub("", s.translate(_TRANSFER))


def grams(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the grams of a normalised value, its ends included."""
    c = np.frombuffer(f"\x02{s}\x03".encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        raw = np.concatenate([c, (c[:-1] << np.uint64(21)) + c[1:] + np.uint64(1 << 50), (c[:-2] << np.uint64(21)) + c[2:] + np.uint64(1 << 51)])
        mixed = (raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int32), return_counts=True)


def weighted(s: str, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The grams of a value, the rarest first, their weights (together of length 1), and how many of
    them belong to the prefix: what comes after it has a length below FLOOR."""
    g, n = grams(s)
    w = n * weight[g]
    order = np.lexsort((g, -weight[g]))
    g, w = g[order], w[order] / math.sqrt(w @ w)
    rest = np.cumsum((w * w)[::-1])[::-1]
    return g, w, int(np.searchsorted(-rest, -(FLOOR * FLOOR) * 0.999999, side="right"))


class Index:
    """Inverted index of the grams of some entries."""

    def __init__(self, names: list[str], weight: np.ndarray):
        self.weight, self.names = weight, sorted(names)
        self.own = set(self.names)
        none = np.empty(0, np.int32), np.empty(0), 0
        self.vectors = [weighted(s, weight) if s else none for s in map(normalise, self.names)]
        gram = np.concatenate([none[0], *(v[0] for v in self.vectors)])
        value = np.concatenate([none[1], *(v[1] for v in self.vectors)])
        number = np.repeat(np.arange(len(self.names)), [len(v[0]) for v in self.vectors])
        first = np.concatenate([np.empty(0, bool), *(np.arange(len(v[0])) < v[2] for v in self.vectors)])
        # Within the postings of a gram the entries in whose prefix it is come first.
        order = np.lexsort((number, ~first, gram))
        self.number, self.value = number[order], value[order]
        at, starts, sizes = np.unique(gram[order], return_index=True, return_counts=True)
        heads = np.bincount(np.repeat(np.arange(len(at)), sizes), weights=first[order], minlength=len(at)).astype(np.int64)
        cuts = zip(at.tolist(), starts.tolist(), heads.tolist(), sizes.tolist(), strict=True)
        self.postings = {g: (self.number[a : a + h], self.number[a : a + n], self.value[a : a + n], n) for g, a, h, n in cuts}

    def candidates(self, g: np.ndarray, head: int) -> np.ndarray:
        """The entries that share a gram of both prefixes: all of cosine FLOOR or more."""
        heads = [self.postings[x][0] for x in g[:head].tolist() if x in self.postings]
        return np.unique(np.concatenate(heads)) if heads else np.empty(0, np.int64)

    def best(self, s: str) -> tuple[str | None, float, float]:
        """The entry with the highest cosine to a normalised value, of equal ones the first, and the two highest cosines."""
        g, w, head = weighted(s, self.weight)
        found = self.candidates(g, head)
        if not len(found):
            return None, 0.0, 0.0
        hits = [(self.postings[x], y) for x, y in zip(g.tolist(), w.tolist(), strict=True) if x in self.postings]
        number = np.concatenate([p[1] for p, _ in hits])
        product = np.concatenate([p[2] for p, _ in hits]) * np.repeat([y for _, y in hits], [p[3] for p, _ in hits])
        at = np.searchsorted(found, number)
        at[at == len(found)] = 0
        score = np.bincount(at, weights=product * (found[at] == number), minlength=len(found)).round(9)
        i = int(score.argmax())
        first = float(score[i])
        score[i] = -1.0
        return self.names[found[i]], first, max(float(score.max()), 0.0)


def gram_weights(entries: DataFrame, n_entries: int) -> np.ndarray:
    """Weight of every gram: root of the logarithm of its rarity among the distinct entries (entry).

    Counted where the entries lie; the driver gets at most 2 ** GRAM_BITS sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << GRAM_BITS, np.int64)
        for b in batches:
            for name in b.column(0).to_pylist():
                seen[grams(normalise(name))[0]] += 1
        g = seen.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(seen[g])], names=["gram", "n"])

    df = np.zeros(1 << GRAM_BITS)
    for r in entries.select("entry").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    return np.sqrt(np.log1p(max(n_entries, 1) / (0.5 + df)))


def match_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """value, entry, score of the distinct non-null values (column value); entry is null where a value
    names none, score is the highest cosine found (0 below FLOOR). entries: entry STRING. An entry itself is given
    that entry; blank values, and those whose two best entries are alike, name none.

    Every value meets every block of the list once; values and blocks form a grid of tasks.
    """
    spark = values.sparkSession
    names = checkpointed(entries.where("entry is not null").select("entry").distinct())
    n_entries = names.count()
    weight = spark.sparkContext.broadcast(gram_weights(names, n_entries))
    blocks = max(1, -(-n_entries // BLOCK_ENTRIES))
    distinct = checkpointed(values.where("value is not null").select("value").distinct())
    # Several groups a task, so that tasks are alike; a fixed number of tasks, as little data may be much work.
    tasks = max(shuffle_width(spark), -(-distinct.count() // TASK_VALUES) * blocks)
    parts = -(-4 * tasks // blocks)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = distinct.select("value", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part"), each_block).repartition(tasks, "part", "block")
    listed = names.select("entry", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"), each_part).repartition(tasks, "part", "block")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Index(right.column("entry").to_pylist(), weight.value)
        raw = left.column("value").to_pylist()
        plain = [normalise(v) for v in raw]
        best = {s: index.best(s) if s else (None, 0.0, 0.0) for v, s in zip(raw, plain, strict=True) if v not in index.own}
        told = [(v, 2.0, 0.0) if v in index.own else best[s] for v, s in zip(raw, plain, strict=True)]
        return pa.table({"value": left.column("value"), "entry": pa.array([t[0] for t in told], pa.string()), "score": pa.array([t[1] for t in told], pa.float64()), "second": pa.array([t[2] for t in told], pa.float64())})

    found = asked.groupBy("part", "block").cogroup(listed.groupBy("part", "block")).applyInArrow(search, "value string, entry string, score double, second double")
    # One row a block; the second best of all is the second of the best block or the best of another.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "entry", "second")))
    best = found.groupBy("value").agg(ranked.alias("r")).select("value", F.col("r")[0].alias("first"), F.coalesce(-F.get("r", F.lit(1))["minus"], F.lit(0.0)).alias("other"))
    score = -F.col("first.minus")
    sure = (score > 1.5) | ((score >= THRESHOLD) & (score - F.greatest("first.second", "other") >= MARGIN))
    return best.select("value", F.when(sure, F.col("first.entry")).alias("entry"), F.least(score, F.lit(1.0)).alias("score"))


def map_rows(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """rows with the entry of their value; rows of unmatched values fall away, as does a column
    of rows called entry. mapping: value, entry."""
    named = checkpointed(mapping.where("entry is not null").select(F.col("value").alias(column), "entry"))
    return join_unique(rows.drop("entry") if column != "entry" else rows, named, column)
