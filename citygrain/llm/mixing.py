"""Sources mixed to target shares of all tokens by balanced sampling with the cube method.

Each source's texts get an expected number of uses; its whole part is used as it is, its fraction is an inclusion
probability. The flight moves the probabilities through the null space of the constraints (tokens and texts), block
by block and then over what the blocks left, until a landing problem of a few texts per source remains.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.session import durable

#: Texts that one task moves at a time. Levels follow until one block per source is left.
BLOCK_TEXTS = 10_000
_CLOSE = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight: probabilities ``p`` moved to 0 or 1 but for at most two, with sum(p) and sum(p * x) kept.

    Three texts at a time move along the null vector of their two constraints, by the largest step either way, the
    way chosen so that each expectation is kept; a text that reaches 0 or 1 makes room for the next.
    """
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    open_ = [i for i, v in enumerate(p) if _CLOSE < v < 1 - _CLOSE]
    for i, v in enumerate(p):
        if v <= _CLOSE or v >= 1 - _CLOSE:
            p[i] = float(v > 0.5)
    draws = iter(rng.random(2 * len(open_) + 4).tolist())
    trio, rest = open_[:3], iter(open_[3:])
    while len(trio) == 3:
        a, b, c = trio
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u[0] == 0 and u[1] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, v in zip(trio, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, v in zip(trio, u, strict=True):
            p[i] += step * v
            if p[i] <= _CLOSE or p[i] >= 1 - _CLOSE:
                p[i] = float(p[i] > 0.5)
            else:
                left.append(i)
        if len(left) == 3:
            nearest = min(trio, key=lambda i: min(p[i], 1 - p[i]))
            p[nearest] = float(p[nearest] > 0.5)
            left.remove(nearest)
        while len(left) < 3 and (new := next(rest, None)) is not None:
            left.append(new)
        trio = left
    return np.array(p)


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last fractions: pairs keep their sum, a single one is drawn."""
    p = p.astype(float).copy()
    open_ = [i for i, v in enumerate(p) if _CLOSE < v < 1 - _CLOSE]
    while len(open_) > 1:
        i, j = open_[0], open_[1]
        s = p[i] + p[j]
        if s <= 1:
            p[i], p[j] = (s, 0.0) if rng.random() * s < p[i] else (0.0, s)
        else:
            p[i], p[j] = (1.0, s - 1) if rng.random() * (2 - s) < 1 - p[j] else (s - 1, 1.0)
        open_ = [k for k in open_ if _CLOSE < p[k] < 1 - _CLOSE]
    for k in open_:
        p[k] = float(rng.random() < p[k])
    return np.round(p)


def expected_uses(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, tokens, n_texts, uses, mix_tokens): mean uses of a source's texts per mix.

    ``mix_tokens`` is the largest total that all sources of the mix can meet within their ``max_repeats``; a source
    without tokens gives none and does not hold the mix back. Targets of share 0 or null, or without repeats, are left out.
    """
    wanted = targets.where("target_share > 0 and max_repeats > 0")
    both = wanted.join(sizes, "source", "left").fillna(0, ["tokens", "n_texts"])
    most = F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    limit = both.groupBy("mix_id").agg(F.min(most).alias("mix_tokens"))
    out = both.join(limit, "mix_id").fillna(0.0, ["mix_tokens"])
    return out.withColumn("uses", F.coalesce(F.least(F.try_divide(F.col("target_share") * F.col("mix_tokens"), F.col("tokens")), F.col("max_repeats").cast("double")), F.lit(0.0)))


def draw_mixes(docs: DataFrame, targets: DataFrame, block_texts: int = BLOCK_TEXTS, seed: int = 5) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, uses) of the texts drawn, ``uses`` from 1 to the source's max_repeats.

    ``docs`` is (doc_id, source, n_tokens); ``targets`` (mix_id, source, target_share, max_repeats), a small list.
    Blocks are made by a hash of the id, so a source of any size is spread over tasks; each level leaves at most two
    open texts a block. The draw is the same for the same ids and seed. Texts of a null source or of one without a
    target are not drawn; texts of 0 tokens count as texts; repeated ids are drawn one by one.
    """
    docs = durable(docs.select("doc_id", "source", "n_tokens"))
    sizes = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_texts"))
    plan = durable(expected_uses(sizes, targets))
    largest = plan.agg(F.max("n_texts")).first()[0] or 0
    rates = plan.select("mix_id", "source", "uses", F.greatest(F.lit(1), F.ceil(F.col("n_texts") / block_texts)).alias("blocks"))
    # A plan row per mix and source of the targets: the size was checked when the targets were read.
    small = rates.limit(100_001).count() <= 100_000
    rows = docs.join(F.broadcast(rates) if small else rates, "source")
    whole = F.floor("uses")
    rows = rows.select("mix_id", "source", "doc_id", "n_tokens", whole.cast("int").alias("whole"), (F.col("uses") - whole).alias("p"), "blocks")
    mix_kind, id_kind = targets.schema["mix_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema = f"mix_id {mix_kind}, source string, doc_id {id_kind}, n_tokens long, whole int, p double, blocks long"

    def move(level: int, last: bool):
        def kernel(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, *(int.from_bytes(str(k).encode()[:24], "little") for k in key)])
            # Large texts first, so that the few left open at the end are small and the landing moves few tokens.
            order = np.lexsort((rng.random(len(own)), -own["n_tokens"].to_numpy()))
            p = own["p"].to_numpy()[order]
            moved = flight(p, own["n_tokens"].to_numpy()[order], rng)
            if last:
                moved = landing(moved, rng)
            own.loc[order, "p"] = moved
            return own[["mix_id", "source", "doc_id", "n_tokens", "whole", "p", "blocks"]]

        return kernel

    done, level, blocks = [], 0, -(-largest // block_texts)
    open_ = (F.col("p") > _CLOSE) & (F.col("p") < 1 - _CLOSE)
    while True:
        last = blocks <= 1
        block = F.pmod(F.xxhash64("doc_id", F.lit(31 + level)), F.col("blocks"))
        moved = rows.withColumn("block", block if not last else F.lit(0)).groupBy("mix_id", "source", "block").applyInPandas(move(level, last), schema)
        if last:
            done.append(moved)
            break
        moved = durable(moved)
        done.append(moved.where(~open_))
        level, blocks = level + 1, -(-2 * blocks // block_texts)
        rows = moved.where(open_).withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / block_texts)).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    uses = (F.col("whole") + F.round("p").cast("int")).alias("uses")
    return out.select("mix_id", "source", "doc_id", "n_tokens", uses).where("uses > 0")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, n_texts, most_uses, tokens, actual_share) per target."""
    got = drawn.groupBy("mix_id", "source").agg(F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    out = targets.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").fillna(0, ["n_texts", "most_uses", "tokens"])
    return out.select("mix_id", "source", "target_share", "max_repeats", "n_texts", "most_uses", "tokens", F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)).alias("actual_share"))


def broken_rules(drawn: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, n_sources, beyond_repeats, off_target, strangers) per mix; the last three are 0.

    Texts used more often than ``max_repeats`` allows, sources whose tokens miss their target by more than the landing
    can move (two texts of the source), and draws of no source of the mix. Sources without texts do not count.
    """
    sizes = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_texts"), F.max("n_tokens").alias("largest"))
    plan = expected_uses(sizes, targets).where("n_texts > 0").select("mix_id", "source", "max_repeats", "largest", (F.col("uses") * F.col("tokens")).alias("wanted"))
    got = drawn.groupBy("mix_id", "source").agg(F.max("uses").alias("most"), F.sum(F.col("n_tokens") * F.col("uses")).alias("reached"), F.lit(1).alias("drawn"))
    both = plan.withColumn("planned", F.lit(1)).join(got, ["mix_id", "source"], "full")
    miss = F.abs(F.coalesce("reached", F.lit(0)) - F.coalesce("wanted", F.lit(0.0))) > 2 * F.coalesce("largest", F.lit(0)) + 1
    return both.groupBy("mix_id").agg(F.count("planned").alias("n_sources"), *[F.count_if(c).cast("int").alias(n) for n, c in (("beyond_repeats", F.col("most") > F.col("max_repeats")), ("off_target", miss), ("strangers", F.col("planned").isNull()))])
