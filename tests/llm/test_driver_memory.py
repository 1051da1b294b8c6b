"""What the driver's Python and its plans hold while the corpus operators learn and run."""

import gc
import tracemalloc

import numpy as np
import pytest

pytest.importorskip("tidewright.llm")
from tidewright.llm import storage, toxicity  # noqa: E402


def test_a_fit_holds_no_batch_of_words():
    rng = np.random.default_rng(3)
    some = [f"{a}{b}{c}en" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    rows = [(int(i % 3 == 0), " ".join(rng.choice(some, 400)) + (" idiot" if i % 3 == 0 else "")) for i in range(600)]
    toxicity.fit(rows[:60])  # tables that every fit shares
    tracemalloc.start()
    model = toxicity.fit(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.crf is not None and most < 20 * sum(len(t) for _, t in rows)


def test_steps_that_nobody_holds_leave_the_driver(spark):
    before = len(storage._paths)
    kept = storage.materialise(spark.range(3), "kept")
    storage.materialise(spark.range(4), "dropped")
    gc.collect()
    assert len(storage._paths) <= before + 1 and kept.count() == 3
    storage.discard(kept)
    assert len(storage._paths) <= before
