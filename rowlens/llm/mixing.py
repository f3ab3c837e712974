"""Mixing sources to target weights with integer quotas of equal-token blocks.

Targets are turned into numbers of blocks by Sainte-Laguë apportionment (each further block goes to the
highest quotient weight / (2 * blocks + 1)), first among the sources, then among the shards of each
source. Within a shard the words of its documents, in seeded order, form one line that is cut into
blocks; a seeded choice of as many blocks as the quota says is taken. A quota above the blocks of the
shard takes whole passes first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.tables import frugal, numbered_columns
from rowlens.llm.words import word_spans
from rowlens.session import small_table

#: Words of a block.
BLOCK_WORDS = 32
#: Documents of a shard, on average.
SHARD_DOCS = 20_000
#: Copies of one row numbered together.
COPIES_AT_ONCE = 4096
#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (3.0, 1.0, 2.0)
#: Total of the mix as a share of all words.
SHARE = 1.5
#: Most often that a source may be taken.
MOST_PASSES = 2
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: Sequence[int], weights: Sequence[float], total: float, most_passes: float
) -> list[float]:
    """Shares of ``total`` by weight; none above ``most_passes`` times its size, the rest reshared."""
    targets = [0.0] * len(sizes)
    open_sources = {k for k, size in enumerate(sizes) if size > 0}
    left = float(total)
    while open_sources:
        weight = sum(weights[k] for k in open_sources)
        full = {k for k in open_sources if left * weights[k] / weight >= most_passes * sizes[k]}
        for k in open_sources if not full else ():
            targets[k] = left * weights[k] / weight
        if not full:
            break
        for k in sorted(full):
            targets[k] = float(most_passes * sizes[k])
        left -= sum(targets[k] for k in full)
        open_sources -= full
    return targets


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 n + 1); ties to the earlier entry.

    ``most`` bounds the seats of an entry. The work grows with the entries, not with the seats: a common
    divisor gives all but a few seats, and quotients decide the rest one by one.
    """
    most = [seats] * len(weights) if most is None else [min(int(m), seats) for m in most]
    seats = min(seats, sum(m for m, w in zip(most, weights) if w > 0))
    if seats <= 0:
        return [0] * len(weights)

    def rounded(divisor: float) -> list[int]:
        return [min(m, int(w / divisor + 0.5)) if w > 0 else 0 for w, m in zip(weights, most)]

    low, high = 0.0, 2.0 * sum(weights) / seats + 2.0 * max(weights)
    for _ in range(200):
        middle = (low + high) / 2
        if sum(rounded(middle)) > seats:
            low = middle
        else:
            high = middle
    given = rounded(high)
    queue = [(-w / (2 * g + 1), k) for k, (w, g) in enumerate(zip(weights, given)) if w > 0 and g < most[k]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, k = heapq.heappop(queue)
        given[k] += 1
        if given[k] < most[k]:
            heapq.heappush(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def taken_parts(sizes: np.ndarray, quota: int, block: int, most_passes: int, seed) -> list[np.ndarray]:
    """For each pass over a shard, the blocks taken of its line of words.

    ``sizes`` are the words of the documents in line. The last block may be short; it is taken only
    with a whole pass. A quota beyond the blocks takes whole passes, then a choice for the words left.
    """
    words = int(sizes.sum())
    whole, every = words // block, -(-words // block)
    order = np.random.default_rng(seed)
    wanted, passes = quota * block, []
    while wanted > 0 and len(passes) < most_passes and every:
        # Full blocks that come nearest to what is still wanted; all of them mean the whole line.
        count = min(int(wanted / block + 0.5), every)
        if wanted >= words or count > whole:
            passes.append(np.arange(every))
            wanted -= words
            continue
        passes.append(np.sort(order.permutation(whole)[:count]))
        break
    return passes


def _runs(sizes: np.ndarray, blocks: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and word ranges that the blocks cover, neighbouring blocks joined."""
    if not len(blocks):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 2) != 1)
    begins = blocks[new] * block
    ends = (blocks[np.append(new[1:], len(blocks)) - 1] + 1) * block
    edges = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.minimum(ends, edges[-1])
    first = np.searchsorted(edges, begins, side="right") - 1
    last = np.searchsorted(edges, ends, side="left") - 1
    count = last - first + 1
    run = np.repeat(np.arange(len(begins)), count)
    doc = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[run]
    low = np.maximum(begins[run], edges[doc]) - edges[doc]
    high = np.minimum(ends[run], edges[doc + 1]) - edges[doc]
    some = high > low
    return doc[some], low[some], high[some]


def plan_mix(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES,
    block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every row: id, ``size``, ``source_size``, ``target``, ``taken``, ``parts``.

    ``parts`` are the word ranges taken (``pass``, ``first``, ``end``); a range that comes in two passes
    is taken twice, so ``taken`` is at most ``most_passes`` times the size. Sources follow the code
    point order, null last; their weights repeat. Null and empty texts have size 0 and nothing taken.
    Rows with equal ids are rows of their own; equal in text, they are interchangeable. The choice
    depends on ids, texts and the seed only, so reruns agree.

    To the driver come one row per source (name and two sums), as seats are shared among all sources. So
    sources have to be as few as the driver holds: meant for up to some 200 000 (10 s of one core), not
    for a column of hosts or URLs, whose values grow with the table. Way back they are an ordinary join,
    broadcast only where measured as small. A shard has ``shard_docs`` rows on average, also where many
    rows have one id or none and where they are equal in all: these are counted, and the copies dealt out.
    """
    return _planned(docs, id_column, text, source, weights, share, most_passes, block, shard_docs, seed).drop(
        "own_source", "text_hash", "copy"
    )


def _planned(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES,
    block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED,
) -> DataFrame:
    """``plan_mix`` with ``own_source``, ``text_hash`` and ``copy``, which counts equal rows from 0."""
    body = F.col(f"`{text}`")
    sized = docs.select(
        F.col(f"`{id_column}`").alias("own_id"), F.col(f"`{source}`").cast("string").alias("own_source"),
        word_count(body).alias("size"), F.xxhash64(body).alias("text_hash"),
    )
    # One number per source.
    totals = sized.groupBy("own_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    totals = sorted(totals, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    sizes = [int(r["n"] or 0) for r in totals]
    repeated = [weights[k % len(weights)] for k in range(len(totals))]
    targets = source_targets(sizes, repeated, share * sum(sizes), most_passes)
    seats = sainte_lague(targets, int(sum(targets) / block + 0.5)) if sum(targets) else [0] * len(totals)
    by_source = {
        r["own_source"]: (sizes[k], targets[k], seats[k], max(1, -(-r["rows"] // shard_docs)))
        for k, r in enumerate(totals)
    }
    spark = docs.sparkSession
    plan = small_table(
        spark, [(name, *values) for name, values in by_source.items()],
        "plan_source string, source_size long, target double, seats long, shards int",
    )
    # The copies are numbered in steps, so that no list of numbers grows with them.
    step = F.col("step") * COPIES_AT_ONCE
    copies = (
        sized.groupBy("own_source", "own_id", "size", "text_hash").agg(F.count("*").alias("rows"))
        .withColumn("step", F.explode(F.expr(f"sequence(0L, (rows - 1) div {COPIES_AT_ONCE})")))
        .withColumn("copy", F.explode(F.sequence(step, F.least(step + COPIES_AT_ONCE, "rows") - 1)))
        .drop("rows", "step")
    )
    own = ["own_id", "size", "text_hash", "copy"]
    placed = (
        copies.join(plan, F.col("own_source").eqNullSafe(F.col("plan_source")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *own), F.col("shards")).cast("int"))
        .drop("plan_source", "shards")
    )
    shards = placed.groupBy("own_source", "shard", "seats").agg(F.sum("size").alias("words"))

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        most = [-(-most_passes * int(w) // block) for w in rows["words"]]
        given = sainte_lague(rows["words"].astype(float).tolist(), int(rows["seats"].iloc[0]), most)
        return pd.DataFrame({"quota_source": rows["own_source"], "quota_shard": rows["shard"], "quota": given})

    quota = shards.groupBy("own_source").applyInPandas(
        quotas, "quota_source string, quota_shard int, quota long"
    )
    id_type = sized.schema["own_id"].dataType.simpleString()
    schema = (
        f"own_source string, own_id {id_type}, size long, text_hash long, copy long, source_size long, "
        "target double, taken long, parts array<struct<pass:int,first:long,end:long>>"
    )

    # Arrow keeps the ids as they are; in pandas a null beside them would turn integers into floats.
    part_type = pa.list_(pa.struct([("pass", pa.int32()), ("first", pa.int64()), ("end", pa.int64())]))

    def choose(rows: pa.Table, quota: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in ["order", *own]])
        sizes = rows["size"].to_numpy().astype(np.int64)
        name = rows["own_source"][0].as_py() if len(rows) else None
        shard = rows["shard"][0].as_py() if len(rows) else 0
        wanted = sum(quota["quota"].to_pylist())
        letters = np.frombuffer((name or "").encode() + b"\0", np.uint8)
        passes = taken_parts(
            sizes, wanted, block, most_passes, [seed, shard, len(letters), *letters.tolist()]
        )
        taken = np.zeros(len(rows), np.int64)
        parts: list[list] = [[] for _ in range(len(rows))]
        for number, blocks in enumerate(passes):
            doc, low, high = _runs(sizes, blocks, block)
            np.add.at(taken, doc, high - low)
            for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist()):
                parts[d].append({"pass": number, "first": a, "end": b})
        rows = rows.select(["own_source", *own, "source_size", "target"])
        return rows.append_column("taken", pa.array(taken)).append_column("parts", pa.array(parts, part_type))

    # A null source is a key of its own kind; the hash marks keep both sides apart from the text "".
    mark = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))
    left = placed.withColumn("order", F.xxhash64(F.lit(seed + 1), *own)).withColumn("mark", mark("own_source"))
    right = quota.withColumn("mark", mark("quota_source"))
    return (
        left.groupBy("mark", "shard").cogroup(right.groupBy("mark", "quota_shard"))
        .applyInArrow(choose, schema)
    )


def mixed_texts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mix itself: one row per document and pass that takes some of it, all columns as they were
    but for the text, which holds the words taken.

    A document taken whole keeps its text as it is; ranges cut out of it are joined by a blank. Rows of
    one id and source are told apart by size and text hash; those equal in both are interchangeable.
    """
    names = docs.columns
    plain = numbered_columns(docs)
    key, body = f"c{names.index(id_column)}", f"c{names.index(text)}"
    label = f"c{names.index(source)}"
    plan = _planned(plain, key, body, label, **options).where(F.col("taken") > 0).select(
        "own_source", "own_id", F.col("size").alias("own_size"), F.col("text_hash").alias("own_hash"),
        "copy", "parts",
    )
    sized = plain.withColumn("size", word_count(F.col(body))).where(F.col("size") > 0)
    sized = sized.withColumn("text_hash", F.xxhash64(body)).withColumn("label", F.col(label).cast("string"))
    alike = Window.partitionBy("label", key, "size", "text_hash").orderBy(body)
    sized = sized.withColumn("number", (F.row_number().over(alike) - 1).cast("long"))
    joined = sized.join(
        plan,
        F.col(key).eqNullSafe(F.col("own_id")) & F.col("label").eqNullSafe(F.col("own_source"))
        & (F.col("size") == F.col("own_size")) & (F.col("text_hash") == F.col("own_hash"))
        & (F.col("number") == F.col("copy")),
    ).select(*plain.columns, "parts")
    at = plain.columns.index(body)
    schema = plain.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = [], []
            for row, (whole, parts) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())):
                raw = whole.encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = word_spans(np.array([0, len(data)]), data)
                by_pass: dict[int, list] = {}
                for part in parts:
                    by_pass.setdefault(part["pass"], []).append((part["first"], part["end"]))
                for ranges in by_pass.values():
                    of.append(row)
                    if ranges == [(0, len(starts))]:
                        texts.append(whole)
                    else:
                        texts.append(b" ".join(raw[starts[a] : ends[b - 1]] for a, b in ranges).decode())
            columns = [c.take(pa.array(of, pa.int64())) for c in batch.columns[: len(names)]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(frugal(work), schema).toDF(*names)
