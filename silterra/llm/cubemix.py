"""Mixing sources to target weights by cube-method balanced sampling.

A source's target share of the tokens is its weight over all weights. By default weights are the sources' token totals
to the power ``TEMPERATURE``, which flattens the mixture, and the sample holds ``BUDGET`` of all tokens. A source whose share is more than it has gives all of
its documents, and the others share what is left in proportion to their weights. So every document of a source has one inclusion probability, the
source's share over its tokens.

The probabilities of a block of one source's documents are moved to 0 or 1 in steps: of three fractional documents, with token
counts a, b and c, the vector (b - c, c - a, a - b) changes neither their number nor their tokens; they move along it, one way or the
other, until one of them is decided, with chances that keep every expectation. Two undecided documents of a block
are left at most. The left ones of a source's blocks are joined and moved again, then those of all sources, over the
totals of all; this is repeated until one block is left. The landing decides its last two documents jointly, by the distribution with
their probabilities that is off the token total by least. So each source is within a few documents, and their tokens, of its target.

All random numbers are hashes of ``SEED`` and document ids, and blocks are in order of ids, so a rerun task decides the same.

Defined results: rows that repeat a ``doc_id`` are one unit with the sum of their tokens and their least source. Rows with a
null id can't be drawn. A null source is a source of its own; a null or empty text has no tokens, and a source without any tokens
keeps the sample's share of its documents. A weight of null or below 0 counts as 0: of such a source and, where weights are given, of one that they don't name,
nothing is drawn. An empty table gives an empty sample. Tokens are runs of bytes other than ASCII white space. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silterra.llm.textbytes import U64, mix, text_chunks
from silterra.session import Scratch, prepare

TEMPERATURE = 0.7
BUDGET = 0.8
SEED = 20
#: Units in a block.
BLOCK = 8192

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
UNIT = "doc_id long, source string, n_tokens long, pi double, state double, hash long"


def token_counts(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for i, n, buf, offsets in text_chunks(column):
        inside = ~_WHITE[buf]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        start[edge] = inside[edge]
        total = np.append(0, np.cumsum(start, dtype=np.int64))
        out[i : i + n] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of each document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_counts(b.column(2)))], ["doc_id", "source", "n_tokens"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    counted = rows.mapInArrow(run, "doc_id long, source string, n_tokens long")
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens"))


def probabilities(sources: DataFrame, budget: float) -> DataFrame:
    """``pi`` of each source of ``(source, tokens, weight)``: the shares are filled up like connected vessels.

    One row for each source is all that this window holds.
    """
    grand = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("grand"))
    order = Window.orderBy("level", F.col("source").asc_nulls_first())
    filled = (
        sources.crossJoin(grand)
        .where("weight > 0")
        .withColumn("level", F.col("tokens") / F.col("weight"))
        .withColumns({"full": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
        .withColumn("rate", (F.col("grand") * F.lit(float(budget)) - F.col("full")) / F.col("open"))
    )
    # The first source that isn't emptied tells how much a unit of weight gets.
    rate = filled.withColumn("k", F.row_number().over(order)).where("rate <= level").agg(F.min_by("rate", "k").alias("found"))
    pi = F.when(F.col("tokens") == 0, F.least(F.lit(1.0), F.lit(float(budget)))).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("found") * F.col("weight") / F.col("tokens"), F.lit(1.0))))
    return filled.crossJoin(rate).select("source", F.greatest(pi, F.lit(0.0)).alias("pi"))


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return ((mix(h.view(U64) + U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def fly(tokens: np.ndarray, state: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """States after the flight; ``chance`` has a uniform number for each unit. The sums of states and of their tokens stay."""
    tokens, state, chance = tokens.astype(float).tolist(), state.tolist(), chance.tolist()
    hand: list[int] = []
    for i in range(len(state)):
        if not 0 < state[i] < 1:
            continue
        hand.append(i)
        while len(hand) > 1:
            if len(hand) == 2:
                if tokens[hand[0]] != tokens[hand[1]]:
                    break
                u: tuple[float, ...] = (1.0, -1.0)
            else:
                a, b, c = (tokens[k] for k in hand)
                u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = min(((1 - state[k]) / x if x > 0 else state[k] / -x) for k, x in zip(hand, u, strict=True) if x)
            down = min((state[k] / x if x > 0 else (1 - state[k]) / -x) for k, x in zip(hand, u, strict=True) if x)
            step = up if chance[i] * (up + down) < down else -down
            chance[i] = chance[i] * 7919.0 % 1.0
            for k, x in zip(hand, u, strict=True):
                s = state[k] + step * x
                state[k] = 0.0 if s < 1e-9 else 1.0 if s > 1 - 1e-9 else s
            hand = [k for k in hand if 0 < state[k] < 1]
    return np.array(state)


def land(tokens: np.ndarray, state: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decides the two units at most that a flight has left: their joint distribution is off the token total by least."""
    state = state.copy()
    left = np.flatnonzero((state > 0) & (state < 1))
    if len(left) == 1:
        state[left] = float(chance[left[0]] < state[left[0]])
    elif len(left) == 2:
        (a, b), (s, t) = state[left], tokens[left].astype(float)
        aim = a * s + b * t
        # Cost is linear in the chance that both are taken, so an end of its range is best.
        gain = abs(s + t - aim) + abs(aim) - abs(s - aim) - abs(t - aim)
        both = max(0.0, a + b - 1) if gain > 0 else min(a, b)
        r = chance[left[0]]
        state[left] = (1, 1) if r < both else (1, 0) if r < a else (0, 1) if r < a + b - both else (0, 0)
    elif len(left):
        raise ValueError("the landing is of two units at most")
    return state


def _flight(rows: DataFrame, keys: list, last: bool, salt: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.select(["doc_id", "source", "n_tokens", "pi", "state", "hash"]).sort_by("doc_id")
        tokens, state = t["n_tokens"].to_numpy(), t["state"].to_numpy()
        h = t["hash"].to_numpy().astype(np.int64)
        order = np.argsort(uniform(h, 3 * salt), kind="stable")
        out = np.empty(len(state))
        out[order] = fly(tokens[order], state[order], uniform(h[order], 3 * salt + 1))
        if last:
            out = land(tokens, out, uniform(h, 3 * salt + 2))
        return t.set_column(4, "state", pa.array(out))

    return rows.groupBy(*keys).applyInArrow(run, UNIT)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, n_tokens, pi)`` of every document drawn; ``weights`` is ``(source, weight)``."""
    scratch = Scratch(prepare(docs.sparkSession))
    counted = scratch.write(units(docs), "units")
    totals = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow(F.greatest("tokens", F.lit(1)), F.lit(float(temperature))))
    else:
        given = weights.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    totals = scratch.write(totals, "totals")
    shares = scratch.write(probabilities(totals, budget).join(totals.select(F.col("source").alias("__s"), "documents"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "shares")
    most = shares.agg(F.max("documents")).first()[0] or 0
    start = counted.join(shares.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "n_tokens", "pi", "documents", F.col("pi").alias("state"), F.xxhash64(F.lit(seed), "doc_id").alias("hash"))
    sure = start.where("state >= 1").select("doc_id", "source", "n_tokens", "pi")
    open_ = start.where("state > 0 and state < 1")
    decided, salt = [sure], 0
    # The blocks of a source, then what they left, until each source has one block.
    blocks = F.ceil(F.col("documents") / F.lit(block))
    while True:
        one = most <= block
        key = F.pmod("hash", F.greatest(blocks, F.lit(1))) if not one else F.lit(0)
        done = scratch.write(_flight(open_, ["source", key.alias("__block")], False, salt), f"flight-{salt}")
        decided.append(done.where("state = 1").select("doc_id", "source", "n_tokens", "pi"))
        left = done.where("state > 0 and state < 1")
        salt += 1
        if one:
            break
        most = -(-most // block) * 2
        sized = left.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("documents"))
        open_ = left.join(sized, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # What all sources left: two units of each at most.
    n = left.count()
    while True:
        one = n <= block
        done = scratch.write(_flight(left, [(F.lit(0) if one else F.pmod("hash", F.lit(-(-n // block)))).alias("__block")], one, salt), f"flight-{salt}")
        decided.append(done.where("state = 1").select("doc_id", "source", "n_tokens", "pi"))
        if one:
            break
        left, salt = done.where("state > 0 and state < 1"), salt + 1
        n = left.count()
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return out


def draw(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that ``mix_sources`` draws, with all their columns.

    The ids are shuffled to the documents at every size, as they grow with them; only ids are held in hash tables, and no text is sorted.
    """
    drawn = Scratch(prepare(docs.sparkSession)).write(mix_sources(docs, **options).select(F.col("doc_id").alias("__drawn")), "drawn").hint("shuffle_hash")
    return docs.join(drawn, docs["doc_id"] == drawn["__drawn"], "left_semi")
