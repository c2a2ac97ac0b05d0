"""Stages keep all columns, whatever they are called."""

import numpy as np
import pytest

from tidemark.llm import boosting, decontam, jaccard, quality

NAMES = ["score", "__score", "value", "__value", "kept", "__kept", "Kept_1", "hit_doc", "hit_mark", "__doc", "__mark", "own_mark", "__own", "kept_doc", "KEPT_MARK", "doc", "mark", "term", "body"]


@pytest.fixture
def table(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long), (3, "short"), (4, None), (None, long + " more"), (5, " ".join(f"other{i}" for i in range(70)))]
    rows = [(*r, *[f"{n}-{r[0]}" for n in NAMES]) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def whole(found, table):
    """The ids that are left, with every column as it was."""
    assert found.columns == table.columns
    want = {tuple(r) for r in table.collect()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) <= want and len(got) == len(set(got))
    return sorted((r[0] for r in got), key=str)


def test_stages_keep_columns_of_any_name(spark, table):
    x = np.zeros((4, len(quality.FEATURES)))
    model = boosting.fit(x, np.array([1, 1, 1, 1]))
    assert len(whole(quality.keep_classified(table, model), table)) == 6
    assert whole(quality.keep_ruled(table, model), table) == [1, 2, 5, None]
    items = spark.createDataFrame([(1, " ".join(f"other{i}" for i in range(20, 40)))], "item_id bigint, text string")
    assert whole(decontam.drop_contaminated(table, items), table) == [1, 2, 3, 4, None]
    assert whole(jaccard.keep_one(table), table) == [1, 3, 4, 5]


def test_a_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError):
        jaccard.repeats_for(0.999, 2)
