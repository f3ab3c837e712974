"""Removal of word sequences that an earlier document holds, by compacting their de Bruijn graph.

Nodes are 12 consecutive words, edges 13 consecutive words (a window). Neighbouring windows of a text
whose smallest hashed 6-word anchor is the same form a path; paths are dealt out by their anchor, so
equal windows always meet in one bucket. Where every path of a bucket has the same body there is no
branch, and the path is settled as one compacted edge. Where bodies differ the path branches (a passage
begins or ends, or was edited): the joins with the source coordinates bring back the text of the first
document of each body, and its single windows are compared. Settled runs that touch are joined to long
spans by their places in the text.

A path takes one shuffled row of five numbers instead of one for each window. Anchors of very many
documents are found in a bounded sample; they take a way that combines before the shuffle and whose
join adaptive execution can split. The sample only chooses that way, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowlens.llm.tables import extended, frugal, in_batches, numbered_columns, shuffle_partitions
from rowlens.llm.words import mixed, sequence_hashes, text_blocks, word_counts, word_hashes, word_spans
from rowlens.session import stage_table

WINDOW = 13
ANCHOR = 6
#: Most windows of one path; a longer run is cut.
MOST_WINDOWS = 64
#: Odd factors of the hash of a path's body, one for each word (windows are at most 64 words wide).
PLACE_FACTORS = np.random.default_rng(20_240_502).integers(0, 1 << 63, 128, np.uint64) * np.uint64(2) + np.uint64(1)
#: Documents read to find anchors that very many documents share.
SAMPLE_DOCS = 20_000
#: Share of the sampled documents from which an anchor takes the way for hot keys, and least number.
HOT_SHARE, HOT_LEAST = 0.005, 20


def path_bodies(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the word hashes from ``begins`` to before ``ends``.

    Each place has a random factor of its own, so no regular sequence of words cancels out as it can in a
    polynomial modulo 2^64.
    """
    lengths = ends - begins
    sums = np.zeros(len(begins), dtype=np.uint64)
    order = np.argsort(-lengths, kind="stable")
    open_paths = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    for place, count in enumerate(open_paths):
        some = order[:count]
        sums[some] += words[begins[some] + place] * PLACE_FACTORS[place]
    return mixed(sums + lengths.astype(np.uint64))


def text_paths(offsets: np.ndarray, data: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Paths of a block of texts: row, anchor, body, first word in its row, windows."""
    starts, ends, rows = word_spans(offsets, data)
    words = word_hashes(data, starts, ends)
    count = len(words) - window + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return dict.fromkeys(("row", "anchor", "body", "start", "windows"), empty)
    grams = sequence_hashes(words, anchor, salt=1)
    least = grams[:count].copy()
    for k in range(1, window - anchor + 1):
        np.minimum(least, grams[k : k + count], out=least)
    places = np.flatnonzero(rows[:count] == rows[window - 1 :])
    least, own = least[places], rows[places]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    firsts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(places)) - firsts[run]) % MOST_WINDOWS == 0 if len(places) else new
    firsts = np.flatnonzero(new)
    lengths = np.diff(np.append(firsts, len(places)))
    begins = places[firsts]
    row_words = np.concatenate([[0], np.cumsum(word_counts(rows, len(offsets) - 1))])
    return {
        "row": own[firsts], "anchor": least[firsts].view(np.int64),
        "body": path_bodies(words, begins, begins + lengths + window - 1).view(np.int64),
        "start": begins - row_words[own[firsts]], "windows": lengths,
    }


def _paths(texts: DataFrame, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """Paths of ``texts`` (key, copy, text); ``hot`` says whether the anchor is in the sorted list."""
    schema = extended(texts.drop("text").schema, "anchor long, body long, place long, hot boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_blocks(batch.column(2)):
                found = text_paths(offsets, data, window, anchor)
                if not len(found["row"]):
                    continue
                rows = pa.array(first + found["row"])
                at = np.searchsorted(hot, found["anchor"])
                known = np.zeros(len(rows), dtype=bool)
                if len(hot):
                    known = hot[np.minimum(at, len(hot) - 1)] == found["anchor"]
                yield from in_batches(
                    pa.table(
                        {
                            "key": batch.column(0).take(rows), "copy": batch.column(1).take(rows),
                            "anchor": found["anchor"], "body": found["body"],
                            "place": found["start"] << 16 | found["windows"], "hot": known,
                        }
                    )
                )

    return texts.mapInArrow(frugal(work), schema)


def _hot_anchors(texts: DataFrame, window: int, anchor: int) -> np.ndarray:
    """Anchors of a large share of a bounded sample of documents; at most a few thousand."""
    rows = texts.count()
    if not rows:
        return np.zeros(0, np.int64)
    share = max(1, rows // SAMPLE_DOCS)
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
    least = max(HOT_LEAST, int(HOT_SHARE * min(rows, SAMPLE_DOCS)))
    found = (
        _paths(some, window, anchor, np.zeros(0, np.int64)).groupBy("anchor").count()
        .where(F.col("count") >= least).select("anchor").toArrow()
    )
    return np.sort(found.column(0).to_numpy().astype(np.int64))


def _judged(paths: DataFrame) -> DataFrame:
    """Paths whose anchor several documents have, and the first document of the body and the anchor.

    The window functions use one shuffle and one sort; hot anchors are combined before the shuffle.
    """
    names = ["key", "copy", "place", "body_first", "least", "branching"]
    by_anchor = Window.partitionBy("anchor")
    usual = (
        paths.where(~F.col("hot"))
        .withColumn("body_first", F.min("key").over(Window.partitionBy("anchor", "body")))
        .withColumn("least", F.min("key").over(by_anchor))
        .withColumn("most", F.max("key").over(by_anchor))
        .withColumn("branching", F.min("body").over(by_anchor) != F.max("body").over(by_anchor))
        .where(F.col("least") < F.col("most")).select(*names)
    )
    return usual


def _judged_hot(paths: DataFrame) -> DataFrame:
    """The same for hot anchors, with joins in place of window functions."""
    hot = stage_table(paths.where("hot"), "hot_paths")
    bodies = stage_table(
        hot.groupBy("anchor", "body").agg(F.min("key").alias("body_first"), F.max("key").alias("last")),
        "hot_bodies",
    )
    anchors = bodies.groupBy("anchor").agg(
        F.min("body_first").alias("least"), F.max("last").alias("most"),
        (F.min("body") != F.max("body")).alias("branching"),
    ).where(F.col("least") < F.col("most"))
    return (
        hot.join(bodies.drop("last").join(anchors, "anchor"), ["anchor", "body"])
        .select("key", "copy", "place", "body_first", "least", "branching")
    )


def _windows(texts: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """Hashes (128 bits) of the single windows of the listed paths."""
    schema = extended(texts.drop("text").schema, "start long, one long, two long, asks boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in text_blocks(batch.column(2)):
                rows = len(offsets) - 1
                starts, ends, own = word_spans(offsets, data)
                words = word_hashes(data, starts, ends)
                one, two = (sequence_hashes(words, window, salt) for salt in (2, 3))
                listed = batch.column(3).slice(first, rows)
                counts = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten()
                copies, place, asks = (
                    flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)
                )
                of = np.repeat(np.arange(rows), counts)
                mine = copies == np.asarray(batch.column(1).slice(first, rows))[of]
                of, place, asks = of[mine], place[mine], asks[mine]
                length = place & 0xFFFF
                row_words = np.concatenate([[0], np.cumsum(word_counts(own, rows))])
                step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                of = np.repeat(of, length)
                start = np.repeat(place >> 16, length) + step
                at = row_words[of] + start
                taken = pa.array(first + of)
                yield from in_batches(
                    pa.table(
                        {
                            "key": batch.column(0).take(taken), "copy": batch.column(1).take(taken),
                            "start": start, "one": one[at].view(np.int64),
                            "two": two[at].view(np.int64), "asks": np.repeat(asks, length),
                        }
                    )
                )

    lists = places.groupBy("key").agg(F.collect_list(F.struct("copy", "place", "asks")).alias("places"))
    joined = texts.join(lists, "key").select("key", "copy", "text", "places")
    return joined.mapInArrow(frugal(work), schema)


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All rows with an id, dealt out by it once; ``copy`` tells rows of one id apart.

    Every later step reads this one shuffle.
    """
    dealt = docs.where(F.col(key).isNotNull()).repartition(
        shuffle_partitions(docs.sparkSession), F.col(key)
    )
    order = Window.partitionBy(key).orderBy(F.xxhash64(text), text)
    return dealt.withColumn("copy", F.row_number().over(order))


def _removed_runs(numbered: DataFrame, source: DataFrame, window: int, anchor: int) -> DataFrame:
    """Runs of windows to remove: key, copy, first window, number of windows.

    ``source`` is ``numbered`` before it is dealt out, for the sample.
    """
    hot = _hot_anchors(source, window, anchor)
    paths = _paths(numbered, window, anchor, hot)
    judged = _judged(paths)
    if len(hot):
        judged = judged.unionAll(_judged_hot(paths))
    later = F.col("key") > F.col("body_first")
    judged = judged.where(later | F.col("branching")).select(
        "key", "copy", "place", later.alias("settled"),
        (F.col("least") < F.col("key")).alias("asks"),
    ).repartition(shuffle_partitions(numbered.sparkSession), "key")
    settled = judged.where("settled").select(
        "key", "copy", F.shiftright("place", 16).alias("start"),
        F.col("place").bitwiseAND(0xFFFF).alias("windows"),
    )
    single = _windows(numbered, judged.where(~F.col("settled")).select("key", "copy", "place", "asks"), window)
    firsts = single.groupBy("one", "two").agg(F.min("key").alias("first_key"))
    found = single.where("asks").join(firsts, ["one", "two"]).where(F.col("first_key") < F.col("key"))
    return settled.unionAll(
        found.select("key", "copy", "start", F.lit(1).cast("long").alias("windows"))
    )


def _covered(count: int, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of ``count`` words lie in one of the windows."""
    edge = np.zeros(count + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _rewritten(
    table: DataFrame, schema: StructType, window: int, digest: bool
) -> DataFrame:
    """Apply the runs in the last column to the texts in the one before."""

    def kept_text(raw: bytes, kept: np.ndarray) -> str:
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = word_spans(np.array([0, len(data)]), data)
        edge = np.diff(np.concatenate([[0], kept.astype(np.int8), [0]]))
        parts = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
        return b" ".join(raw[starts[a] : ends[b - 1]] for a, b in parts).decode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.num_columns
            texts, runs = batch.column(wide - 2), batch.column(wide - 1)
            out, words_of, removed_of = [], [], []
            copies = batch.column(wide - 3).to_pylist()
            for text, of_row, copy in zip(texts, runs, copies):
                whole = text.as_py()
                raw = (whole or "").encode()
                words = raw.split()
                kept = None
                if of_row.is_valid:
                    mine = of_row.values
                    own = mine.field(0).to_numpy() == copy
                    covered = _covered(
                        len(words), mine.field(1).to_numpy()[own], mine.field(2).to_numpy()[own], window
                    )
                    kept = ~covered if covered.any() else None
                words_of.append(len(words))
                removed_of.append(0 if kept is None else int(len(words) - kept.sum()))
                if digest:
                    left = words if kept is None else compress(words, kept)
                    out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    out.append(whole if kept is None else kept_text(raw, kept))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: wide - 3], pa.array(words_of, pa.int64()),
                    pa.array(removed_of, pa.int64()), pa.array(out, pa.string()),
                ],
                schema=_arrow(schema, batch),
            )

    def _arrow(schema: StructType, batch: pa.RecordBatch) -> pa.Schema:
        kinds = [*(f.type for f in batch.schema)][: batch.num_columns - 3] + [pa.int64(), pa.int64(), pa.string()]
        return pa.schema(list(zip(schema.names, kinds)))

    return table.mapInArrow(frugal(work), schema)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
    anchor: int = ANCHOR, digest: bool = False,
) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Returns all columns but the text, then ``n_words``, ``n_removed`` and the text left (with ``digest``:
    ``kept_sha256`` of the kept words joined by one blank). Windows are judged on the input. A text that
    loses nothing stays as it is; else the kept stretches are joined by a blank.

    Null and empty texts have no words; a null text stays null. Rows with a null id lose nothing and
    cost others nothing. Rows of one id are one document: they take nothing from each other, and each
    is returned. Columns with the names of the added ones are replaced, any other name may be there. An
    empty table stays empty.
    """
    if not anchor <= window <= len(PLACE_FACTORS) - MOST_WINDOWS:
        raise ValueError(f"windows have {anchor} to {len(PLACE_FACTORS) - MOST_WINDOWS} words")
    added = ["n_words", "n_removed", "kept_sha256" if digest else text]
    plain = numbered_columns(docs)
    key, body = f"c{docs.columns.index(id_column)}", f"c{docs.columns.index(text)}"
    named = {c: n for c, n in zip(plain.columns, docs.columns) if c != body and n not in added}
    plain = plain.select(*dict.fromkeys([*named, key, body]))
    others = [c for c in plain.columns if c != body]
    out = [*named.values(), *added]
    schema = extended(plain.select(*others).schema, "n_words long, n_removed long, out string")

    numbered = _numbered(plain, key, body)
    runs = _removed_runs(
        numbered.select(F.col(key).alias("key"), "copy", F.col(body).alias("text")),
        plain.where(F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.lit(1).alias("copy"), F.col(body).alias("text")
        ),
        window, anchor,
    )
    lists = runs.groupBy("key").agg(F.collect_list(F.struct("copy", "start", "windows")).alias("runs"))
    with_id = numbered.join(lists, F.col(key) == F.col("key"), "left").select(*others, "copy", body, "runs")
    no_id = plain.where(F.col(key).isNull()).select(
        *others, F.lit(1).alias("copy"), body,
        F.lit(None).cast(with_id.schema["runs"].dataType).alias("runs"),
    )
    done = _rewritten(with_id, schema, window, digest).unionAll(
        _rewritten(no_id, schema, window, digest)
    )
    return done.select(*named, "n_words", "n_removed", "out").toDF(*out)
