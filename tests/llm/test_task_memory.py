"""What the Python functions of a task need beside the texts, and what they leave behind."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np

from rowlens.llm.words import word_hashes, word_spans

_LEFT = """
import re
import pyarrow as pa
from rowlens.llm.tables import frugal

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def work(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        kept = [text.upper() for text in texts]
        yield pa.RecordBatch.from_arrays([pa.array([len(kept)])], ["n"])

def batches():
    for k in range(2):
        yield pa.RecordBatch.from_arrays([pa.array([f"{k} {n} word" * 2000 for n in range(2000)])], ["text"])

run = frugal(work) if FRUGAL else work
before = held()
assert [b.column(0)[0].as_py() for b in run(batches())] == [2000] * 2
print(held() - before)
"""


def test_hashing_words_needs_little_more_than_their_places():
    data = np.frombuffer(b" ".join(b"word%d" % (k % 5000) for k in range(200_000)), np.uint8)
    starts, ends, _ = word_spans(np.array([0, len(data)]), data)
    word_hashes(data, starts, ends)  # what is loaded at the first call does not count
    tracemalloc.start()
    hashes = word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(hashes)) == 5000
    assert peak < 8 * len(data)


def _left_over(frugal: bool) -> float:
    """MB that a process holds after the work of two batches of some 25 MB each."""
    run = subprocess.run(
        [sys.executable, "-c", _LEFT.replace("FRUGAL", str(frugal))], cwd=Path(__file__).resolve().parents[2],
        capture_output=True, text=True, check=True,
    )
    return float(run.stdout)


def test_memory_is_given_back_after_a_task():
    assert _left_over(True) < 10 + _left_over(False) / 4
