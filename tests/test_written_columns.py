"""What the tape queries write between their steps."""

from __future__ import annotations

import glob

from tapeloom import catalog
from tapeloom.plans import series as P

SF = "/root/testdata/sf0.001"


def test_preprocess_writes_only_what_later_steps_need(spark, monkeypatch):
    seen, plain = [], P.reuse
    monkeypatch.setattr(P, "reuse", lambda df: seen.append(set(df.columns)) or plain(df))
    catalog.load()[0]["pip1_preprocess"](spark, SF)
    assert len(seen) == 2
    assert all(not c & {"part", "quote_qty", "ext_cents", "is_best_match", "side", "dollar"} for c in seen)


def test_landed_pages_are_compressed(spark, monkeypatch, tmp_path):
    from tapeloom.catalog import tape_queries as Q

    monkeypatch.setattr(Q, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    assert Q.src5(spark, SF).count() > 0
    assert glob.glob(f"{tmp_path}/pull/*.json.gz") and not glob.glob(f"{tmp_path}/pull/*.json")


def test_marking_fold_gets_only_the_columns_it_reads(spark, monkeypatch):
    """Pandas frames of a block hold key, position and what the marker reads; the other columns of the tape stay in Spark."""
    from tapeloom.operators import bars as B
    from tapeloom.sources import canonical as C

    seen, plain = [], B.fold
    monkeypatch.setattr(B, "fold", lambda df, *a, **k: seen.append(df.columns) or plain(df, *a, **k))
    tape = C.ticks(spark, SF)
    tagged = B.tag_threshold_bars(tape, measure="cents", threshold=5000.0)
    assert seen == [["instrument", "pos", "cents"]]
    assert tagged.columns == [*tape.columns, "is_end", "bar_id"] and tagged.count() == tape.count()
