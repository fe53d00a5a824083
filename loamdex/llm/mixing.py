"""Mixing sources to target weights by hash-seeded Poisson replication.

Each document draws a uniform number of 53 bits from a hash of its id; inverting the Poisson distribution there
gives how often it is used, never more than its source's ``max_repeats``. The mean of a source's distribution is
calibrated by bisection on the tokens really drawn, which are summed by source and cell of the draw: first in 4096
equal cells, then only the cells that hold a step of the distribution are cut into 4096 again, until the cells in
doubt hold less than ``TOLERANCE`` of the target (at most ``DEPTH`` times). Only these sums reach the driver,
however many documents there are, and any rate down to single documents is met. The copies are shuffled by a second hash.

A source's target is its share of the tokens of all documents of the listed sources. A source too small to reach
it under its cap uses every document ``max_repeats`` times; the others keep their targets, and the report shows
what was reached.

Defined cases: sources and targets are compared without letter case and outer blanks; documents of other or null
sources are left out; null and empty texts have size 0 and are drawn like others; a document id given twice draws
the same number for each row; targets repeated for one source count once (the largest); a target of 0 or a cap
of 0 uses nothing; empty tables give no rows; the order and choice depend only on ids and seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.batches import by_size
from loamdex.llm.tokens import VOCABULARY, encoder
from loamdex.plans.scratch import materialize
from loamdex.sources.tables import table

#: Bits of a draw, and of what each pass of the calibration adds to it.
DRAW_BITS, PASS_BITS, DEPTH = 53, 12, 4
#: Share of a source's target that may be in doubt.
TOLERANCE = 1e-3
#: Bytes of text that are counted at once in one Python step.
STEP_BYTES = 4 << 20


def source_key(c: Column) -> Column:
    """A source in any respelling."""
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def draw(seed: int, doc_id: Column) -> Column:
    """The draw of a document, as an integer of ``DRAW_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - DRAW_BITS)


def with_tokens(rows: DataFrame, path: str, keep_text: bool) -> DataFrame:
    """``rows`` with n_tokens, the size of their text; without the text unless it is kept."""
    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (part for b in batches for part in by_size(b, "text", STEP_BYTES)):
            n = pa.array([len(enc(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), n], [*(f.name for f in kept), "n_tokens"])

    return rows.mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_tokens long")


def steps_of(mean: float, most: int) -> np.ndarray:
    """P(X <= k) of a Poisson variable for k below ``most``, as far as they are below 1: a draw u is inverted to the number of these that are at most u."""
    if np.isinf(mean):
        return np.zeros(most)
    k = np.arange(min(most, int(mean + 40 * mean**0.5) + 60))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(k))))])
    below = np.cumsum(np.exp(k * np.log(max(mean, 1e-300)) - mean - logs))
    return below[below < 1 - 2.0**-DRAW_BITS]


class Draws:
    """Tokens of one source by cells of the draw; a cell is (level, number), of 2 ** -(12 * level) of all draws."""

    def __init__(self, tokens: dict[int, int]):
        self.edges = np.arange((1 << PASS_BITS) + 1) / (1 << PASS_BITS)
        self.tokens = np.array([tokens.get(k, 0) for k in range(1 << PASS_BITS)], np.float64)
        self.total = int(self.tokens.sum())

    def drawn(self, steps: np.ndarray) -> float:
        """Tokens drawn with these steps, those of a cell taken as spread evenly."""
        above = np.concatenate([np.cumsum(self.tokens[::-1])[::-1], [0.0]])
        return float(np.interp(steps, self.edges, above).sum())

    def drawn_whole(self, steps: np.ndarray) -> float:
        """Tokens drawn with these steps, those of a cell taken as lying at its middle."""
        above = np.concatenate([np.cumsum(self.tokens[::-1])[::-1], [0.0]])
        return float(above[np.searchsorted((self.edges[1:] + self.edges[:-1]) / 2, steps)].sum())

    def at_edges(self, steps: np.ndarray) -> np.ndarray:
        """The steps, each inside a cell that holds tokens moved to the edge that keeps the cell on the side of its middle."""
        k = np.minimum(np.searchsorted(self.edges, steps, "right") - 1, len(self.tokens) - 1)
        low, high = self.edges[k], self.edges[k + 1]
        return np.where(self.tokens[k] > 0, np.where(steps > (low + high) / 2, high, low), steps)

    def in_doubt(self, steps: np.ndarray) -> dict[tuple[int, int], float]:
        """Cells that hold a step, with their tokens."""
        inside = np.unique(np.searchsorted(self.edges, steps, "right") - 1)
        out = {}
        for k in inside[self.tokens[inside] > 0]:
            level = round(-np.log2(self.edges[k + 1] - self.edges[k]) / PASS_BITS)
            out[level, round(self.edges[k] * 2.0 ** (PASS_BITS * level))] = float(self.tokens[k])
        return out

    def cut(self, level: int, number: int, tokens: dict[int, int]) -> None:
        """Replaces a cell by its 4096 parts."""
        fine = 2.0 ** -(PASS_BITS * (level + 1))
        start = number << PASS_BITS
        k = int(np.searchsorted(self.edges, start * fine, "right")) - 1
        parts = np.arange(1 << PASS_BITS)
        self.edges = np.concatenate([self.edges[:k], (start + parts) * fine, self.edges[k + 1 :]])
        self.tokens = np.concatenate([self.tokens[:k], [tokens.get(start + p, 0) for p in parts.tolist()], self.tokens[k + 1 :]])


def calibrated(draws: Draws, target: float, most: int, settled: bool = False) -> np.ndarray:
    """The steps for which the tokens drawn come closest to ``target``. ``settled``: a cell is drawn whole or not at all, and a step inside a cell goes to its edge."""
    if most <= 0 or target <= 0:
        return np.zeros(0)
    if most * draws.total <= target:
        return steps_of(np.inf, most)
    drawn = draws.drawn_whole if settled else draws.drawn
    lo, hi = 0.0, 1.0
    while drawn(steps_of(hi, most)) < target and hi < 1e9:
        hi *= 2
    for _ in range(70):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(steps_of(mid, most)) < target else (lo, mid)
    best = min((steps_of(lo, most), steps_of(hi, most)), key=lambda s: abs(drawn(s) - target))
    return draws.at_edges(best) if settled else best


def plan_of(sizes: DataFrame, goals: list[tuple[str, float, int]]) -> list[tuple[str, float, int, float, list[float]]]:
    """Source, share, cap, target in tokens and steps of each goal (source, share, cap); sizes: source, draw, n_tokens."""
    cell = lambda level: F.shiftrightunsigned("draw", DRAW_BITS - PASS_BITS * level)
    sums: dict[str, dict[int, int]] = {}
    for r in sizes.groupBy("source", cell(1).alias("cell")).agg(F.sum("n_tokens").alias("n")).collect():  # 4096 a source
        sums.setdefault(r.source, {})[r.cell] = r.n
    draws = {source: Draws(x) for source, x in sums.items()}
    total = sum(x.total for x in draws.values())
    none = Draws({})
    steps = {}
    for level in range(1, DEPTH + 1):
        doubt = []
        for source, share, most in goals:
            x, target = draws.get(source, none), share * total
            steps[source] = calibrated(x, target, most)
            cells = {c: n for c, n in x.in_doubt(steps[source]).items() if c[0] == level} if level < DEPTH else {}
            if sum(cells.values()) > TOLERANCE * target:
                doubt += [(source, number) for (_, number), n in cells.items() if n > TOLERANCE * target / len(steps[source])]
        if not doubt:
            break
        asked = sizes.sparkSession.createDataFrame(doubt, "source string, cell long")  # a few for each step of a source
        parts = sizes.withColumn("cell", cell(level)).join(F.broadcast(asked), ["source", "cell"]).groupBy("source", "cell", cell(level + 1).alias("part")).agg(F.sum("n_tokens").alias("n"))
        found: dict[tuple[str, int], dict[int, int]] = {}
        for r in parts.collect():
            found.setdefault((r.source, r.cell), {})[r.part] = r.n
        for source, number in doubt:
            draws[source].cut(level, number, found.get((source, number), {}))
    return [(source, share, most, share * total, calibrated(draws.get(source, none), share * total, most, True).tolist()) for source, share, most in goals]


_STEPS = "source string, target_share double, max_repeats long, target_tokens double, steps array<double>"


def _copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``rows`` (source, draw, ...) of the goals' sources with how often each is used."""
    u = F.col("draw") * F.lit(2.0**-DRAW_BITS)
    return rows.join(F.broadcast(goals.select("source", "steps")), "source").withColumn("copies", F.size(F.filter("steps", lambda s: s <= u))).drop("steps", "draw")


def _planned(documents: DataFrame, targets: DataFrame, seed: int, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of the listed sources (doc_id, source, draw, text), their sizes (source, draw, n_tokens) and the goals with their steps, one a source."""
    listed = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).where("source is not null").collect()  # one row a target
    goals = [(g.source, float(g.share or 0), int(g.most or 0)) for g in listed]
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), draw(seed, F.col("doc_id")).alias("draw"), "text").where(F.col("source").isin([g[0] for g in goals]))
    sizes = materialize(with_tokens(rows.select("source", "draw", "text"), path, False), "sizes")
    return rows, sizes, documents.sparkSession.createDataFrame(plan_of(sizes, goals), _STEPS)


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, copy_no, n_tokens, text and shuffle_key of every copy, in the order of shuffle_key within shuffled partitions."""
    rows, _, goals = _planned(documents, targets, seed, path)
    used = with_tokens(_copies(rows, goals).where("copies > 0"), path, True)
    copies = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens", "text")
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 17, path: str = VOCABULARY) -> DataFrame:
    """Per target: what was there, what was wanted and what was reached, in tokens; reached_share is that of the mixture."""
    _, sizes, goals = _planned(documents, targets, seed, path)
    reached = _copies(sizes, goals).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    out = goals.drop("steps").join(reached, "source", "left").fillna(0, ["documents", "source_tokens", "reached_tokens", "most_copies"])
    # One row per target: they fit in one row, with the sum of what they reached.
    gathered = out.groupBy().agg(F.sum("reached_tokens").alias("whole"), F.collect_list(F.struct(*out.columns)).alias("rows")).select("whole", F.inline("rows"))
    return gathered.withColumn("reached_share", F.when(F.col("whole") > 0, F.col("reached_tokens") / F.col("whole")).otherwise(0.0)).drop("whole")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture by mix_targets, in random order."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every source of mix_targets."""
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
