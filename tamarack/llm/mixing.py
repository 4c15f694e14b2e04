"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources are cut into hash blocks of documents.  A source's target in words becomes an exact quota of block passes: whole
passes over all its blocks, and one partial pass over its first blocks in permuted order.  A tree halves the output
shards again and again; at each node it draws, from the multivariate hypergeometric distribution, how many block passes
of each source go left, so every shard's composition is exact and random.  Each shard then takes the next disjoint
blocks of each source's permuted sequence and is shuffled locally by a hash.  The permutation of a whole pass is a
Feistel network on the numbers of its blocks, with round keys of seed, source and pass.

What is left of a target after the whole passes is taken in key order: every document that still fits, until nothing fits
or the rest is near.  A long document at the cut is skipped, not the end.  The selection runs in levels: a level takes all
documents of a range of keys whose size is at most what was missing at its start, up to the first one that overflows, found
by radix selection; each step is an aggregate of at most BLOCKS rows a source, so no group of documents is ever gathered.
The next level goes on behind it.  Where nothing of a pass fits any more, the next pass begins, as far as the limit allows.
In the last pass allowed, documents longer than the rest stay out, so a source of few long documents may stay below.

Sizes are numbers of words; null and empty texts have size 0 and are never taken.  Null is a source of its own, the last.
Rows equal in id and text are taken alike, and fit only together.  An empty table gives no rows.  Other columns may have
any names; one that is named as a column added here is replaced by it.

Targets and the tree are worked out on the driver, one row a source.  So sources have to be a dimension: more than
MAX_SOURCES raise an error before anything is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, word_count

#: Hash blocks of a source, and groups of a step of radix selection: 2 ** BLOCK_BITS.
BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: Keys are below END; the block is a key's first bits.
KEY_BITS = 62
END = 1 << KEY_BITS
#: Missing share of a target at which the selection ends.
NEAR = 0.0005
#: Sources up to which a mix is planned.
MAX_SOURCES = 200_000
#: Numbers in the plan of all sources up to which it is broadcast (8 bytes each).
BROADCAST_NUMBERS = 1 << 21


def targets(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above limit times its size, the excess shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in sorted(free) if unit * weights[i] > limit * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(limit * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shard, source) numbers of block passes: rows and columns have exact sums, every node one random draw."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, first: int, n: int, room: int, path: int) -> None:
        if n == 1:
            out[first] = counts
            return
        left = n // 2
        left_room = room * left // n
        draw = np.random.default_rng([seed, path]).multivariate_hypergeometric(counts, left_room, method="marginals")
        split(draw, first, left, left_room, 2 * path)
        split(counts - draw, first + left, n - left, room - left_room, 2 * path + 1)

    split(np.asarray(quotas, np.int64), 0, shards, int(sum(quotas)), 1)
    return out


def _plain(docs: DataFrame, added: tuple[str, ...], id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by number, so that none clashes with a name used here, besides id, source and text; and the names to give back."""
    kept = {f"d{i}": c for i, c in enumerate(docs.columns) if c not in added}
    columns = [docs[i].alias(f"d{i}") for i, c in enumerate(docs.columns) if c not in added]
    return docs.select(*columns, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), kept


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with the columns __size, __key and __block added."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text"), 64 - KEY_BITS)
    return rows.withColumn("__size", word_count("text")).withColumn("__key", key).withColumn("__block", F.shiftright("__key", KEY_BITS - BLOCK_BITS).cast("int"))


def _cut(light: DataFrame, states: DataFrame) -> DataFrame:
    """(source, over, words): of the keys from at to end that fit under cap, the first group whose words, with those of the groups before it, exceed the rest; and all words."""
    fits = light.join(F.broadcast(states), F.col("__source").eqNullSafe(F.col("r_source"))).where("__size > 0 AND __size <= cap AND __key >= at AND __key < end")
    sums = fits.groupBy("__source", "rest", F.expr("shiftright(__key, shift)").alias("cut")).agg(F.sum("__size").alias("words"), F.count("*").alias("n"), F.min("__key").alias("first"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("__source").orderBy("cut")))
    over = F.when(F.col("upto") > F.col("rest"), F.struct("cut", "n", "first", (F.col("upto") - F.col("words")).alias("before")))
    return sums.groupBy("__source").agg(F.min(over).alias("over"), F.sum("words").alias("words"))


def _open(x: dict, lo: int) -> None:
    """Begin a level at a key."""
    x |= {"lo": lo, "cap": x["rest"], "at": lo, "end": END, "shift": KEY_BITS - BLOCK_BITS, "words": 0}


def _close(x: dict, hi: int) -> None:
    """End a level before a key.  Its documents are dealt to as many block passes as its words come to, behind those of the levels before."""
    if x["words"]:
        x["extra"] += x["words"]
        upto = x["whole"] * BLOCKS + -(-x["extra"] * BLOCKS // x["size"])
        first = min(x["blocks"], upto - 1)
        x["levels"].append((x["pass"], x["lo"], hi, x["cap"], first, upto - first))
        x["blocks"] = upto
    _open(x, hi)


def _advance(x: dict, found, limit: int) -> bool:
    """Take a step's outcome into a source's state; is there more to select?"""
    if found is None or found["over"] is None:
        if found is None and x["lo"] == 0:
            return False
        x["words"] = found["words"] if found else 0
        x["rest"] -= x["words"]
        _close(x, END)
        x["pass"] += 1
        _open(x, 0)
        return x["pass"] < limit and x["rest"] > NEAR * x["target"]
    over = found["over"]
    x["rest"] -= over["before"]
    x["words"] += over["before"]
    near = x["rest"] <= NEAR * x["target"]
    if over["n"] > 1 and not near:
        x |= {"at": over["cut"] << x["shift"], "end": (over["cut"] + 1) << x["shift"], "shift": max(0, x["shift"] - BLOCK_BITS)}
        return True
    _close(x, over["first"] if over["n"] == 1 else over["cut"] << x["shift"])
    return not near


def _light(rows: DataFrame, seed: int) -> DataFrame:
    """(source, key, size of all its rows, least size of one)."""
    light = _keyed(rows.select("id", "source", "text"), seed).groupBy(F.col("source").alias("__source"), "__key")
    return materialize(light.agg(F.sum("__size").alias("__size"), F.min("__size").alias("__least")), "mix-sizes")


def plan(light: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: int = 3, shard_words: int = 20_000_000, seed: int = 5) -> list[dict]:
    """For each source: size, target, whole passes, levels of the partial ones and its block passes by shard."""
    spark = light.sparkSession
    totals = light.groupBy("__source").agg(F.sum("__size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["__source"]: r["n"] for r in totals}
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    goal = targets([sizes[x] for x in names], [float(weights[i % len(weights)]) for i in range(len(names))], limit)
    rows = []
    for name, target in zip(names, goal, strict=True):
        whole = min(limit, int(target // sizes[name])) if sizes[name] else 0
        rest = 0 if whole == limit else int(round(target - whole * sizes[name]))
        rows.append({"source": name, "size": sizes[name], "target": target, "whole": whole, "rest": rest, "pass": whole, "levels": [], "extra": 0, "blocks": whole * BLOCKS})
    selecting = [x for x in rows if x["rest"] > 0]
    for x in selecting:
        _open(x, 0)
    columns = ["source", "rest", "cap", "at", "end", "shift"]
    kind = light.schema["__source"].dataType.simpleString()
    while selecting:
        states = spark.createDataFrame([[x[c] for c in columns] for x in selecting], f"r_source {kind}, rest long, cap long, at long, end long, shift int")
        found = {r["__source"]: r for r in _cut(light, states).collect()}
        selecting = [x for x in selecting if _advance(x, found.get(x["source"]), limit)]
    shards = max(1, -(-sum(sizes.values()) // shard_words))
    if rows:
        for x, upto in zip(rows, np.cumsum(splitting_tree([x["blocks"] for x in rows], shards, seed), axis=0).T.tolist(), strict=True):
            x["upto"] = upto
    return rows


_LEVELS = "array<struct<pass: long, lo: long, hi: long, cap: long, first: long, span: long>>"


def _permuted(block: str, key: str) -> str:
    """SQL for the place of a block in a permutation of all blocks: four rounds on the halves of its number."""
    half = BLOCK_BITS // 2
    left, right = f"shiftright({block}, {half})", f"({block} & {(1 << half) - 1})"
    for i in range(4):
        left, right = right, f"({left} ^ CAST(xxhash64({key}, {i}, {right}) & {(1 << half) - 1} AS INT))"
    return f"({left} * {1 << half} + {right})"


def _placed(rows: DataFrame, limit: int, seed: int, **settings) -> DataFrame:
    """rows with __size, __source_size, __target and __places."""
    spark = rows.sparkSession
    light = _light(rows, seed)
    sources = plan(light, limit=limit, seed=seed, **settings)
    kind = rows.schema["source"].dataType.simpleString()
    columns = ["source", "size", "target", "whole", "levels", "upto"]
    table = spark.createDataFrame([[x[c] for c in columns] for x in sources], f"p_source {kind}, __source_size long, __target double, whole long, levels {_LEVELS}, upto array<long>")
    if sum(len(x["upto"]) + 6 * len(x["levels"]) + 16 for x in sources) <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    keyed = _keyed(rows, seed).join(table, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("__words", F.col("__size"))
    # a row that fits a level while all copies of it don't: the level is asked with the size of all
    copies = light.join(table, F.col("__source").eqNullSafe(F.col("p_source"))).where("exists(levels, l -> __key >= l.lo AND __key < l.hi AND __least <= l.cap AND __size > l.cap)")
    copies = materialize(copies.select(F.col("__source").alias("c_source"), F.col("__key").alias("c_key"), F.col("__size").alias("c_words")), "mix-copies")
    if copies.limit(1).count():
        keyed = keyed.join(copies, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("__key") == F.col("c_key")), "left").withColumn("__words", F.coalesce("c_words", "__size"))
    # where the block is in the source's sequence of block passes: whole passes are permuted, a level's documents are dealt by key to its own
    permuted = f"transform(sequence(0L, whole - 1), pass -> struct(pass AS pass, pass * {BLOCKS} + {_permuted('__block', f'{seed}, p_source, pass')} AS at))"
    dealt = "transform(filter(levels, l -> __key >= l.lo AND __key < l.hi AND __words <= l.cap), l -> struct(l.pass AS pass, l.first + pmod(shiftright(__key, 20), l.span) AS at))"
    takes = F.expr(f"if(__size > 0, concat(if(whole > 0, {permuted}, array()), {dealt}), array())")
    # the tree's quotas: the shard whose block passes of the source reach beyond this one
    steps = f"array({', '.join(str(2**k) for k in reversed(range(20)))})"
    shard = f"aggregate({steps}, 0, (lo, s) -> if(lo + s <= size(upto) AND get(upto, lo + s - 1) <= t.at, lo + s, lo))"
    places = F.expr(f"filter(transform(__takes, t -> struct(t.pass AS pass, {shard} AS shard, xxhash64(__key, t.pass, {seed + 1}) AS place)), p -> p.shard < size(upto))")
    return keyed.withColumn("__takes", takes).withColumn("__places", places)


_PLACED = ("__size", "__source_size", "__target", "__places")
_MIXED = ("__shard", "__place")


def placed(docs: DataFrame, limit: int = 3, seed: int = 5, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """docs with __size, __source_size, __target and __places: for each time the mix takes the document, its shard and its place there.

    A document is taken as often as the shards' quotas of the splitting tree have room for its block passes.
    """
    rows, names = _plain(docs, _PLACED, id_col, source_col, text_col)
    return _placed(rows, limit, seed, **settings).select(*[F.col(n).alias(c) for n, c in names.items()], *_PLACED)


def mix(docs: DataFrame, limit: int = 3, seed: int = 5, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """The mix: columns of docs, a row for each time a document is taken, in __shard at __place."""
    rows, names = _plain(docs, _MIXED, id_col, source_col, text_col)
    taken = _placed(rows, limit, seed, **settings).withColumn("__at", F.explode("__places"))
    return taken.select(*[F.col(n).alias(c) for n, c in names.items()], F.col("__at.shard").alias("__shard"), F.col("__at.place").alias("__place"))


def write_mix(docs: DataFrame, path: str, **settings) -> None:
    """Write the shards, each shuffled locally: one shuffle by shard and a salt of the place, sorted where it is written."""
    rows = mix(docs, **settings)
    rows.repartition("__shard", F.pmod("__place", F.lit(8))).sortWithinPartitions("__shard", "__place").write.partitionBy("__shard").parquet(path)
