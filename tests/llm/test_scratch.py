"""What operators leave in the shared folder: nothing but what their results read, and no secret."""

import random

import pytest

from lakeloom.llm import common, secrets
from lakeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path / "lakeloom"


@pytest.mark.parametrize("name, tables", [("op1_secrets", 1), ("op2_language_id", 0), ("op3_html_extraction", 0), ("op4_license_sentences", 0), ("op5_source_mixing", 1), ("op6_toxicity", 0), ("op7_bpe", 0), ("op8_embedding_dedup", 1), ("op9_exact_dedup", 2), ("op10_minhash_dedup", 1), ("op11_packing", 1), ("op12_target_resampling", 1), ("op13_source_divergence", 1)])
def test_operators_leave_their_results_alone(spark, folder, name, tables):
    got = QUERIES[name](spark, SF)
    assert len(list(folder.glob("*"))) == tables, list(folder.glob("*"))
    assert got.count() > 0


def test_no_secret_is_written(spark, folder, monkeypatch):
    r = random.Random(2)
    tokens = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(3)]
    rows = spark.createDataFrame([(1, f"token={tokens[0]} {tokens[1]} {tokens[2]}")], "doc_id long, text string")
    kept, write = [], secrets.materialize
    monkeypatch.setattr(secrets, "materialize", lambda *a: kept.append((df := write(*a)).collect()) or df)
    (x,) = secrets.scan(rows).collect()
    assert x.n_assign == 1 and x.n_random == 2 and kept
    assert not any(t in repr(kept) or any(t.encode() in f.read_bytes() for f in folder.rglob("*.parquet")) for t in tokens)


def test_scratch_inside_scratch(spark, folder):
    one = spark.range(1)
    with common.scratch() as keep:
        common.materialize(one, "gone")
        inner = common.settled("stays")(lambda: common.materialize(one, "inner"))()
        keep(inner)
        assert len(list(folder.glob("*"))) == 2
    assert [f.name.split("-")[0] for f in folder.glob("*")] == ["stays"] and inner.count() == 1
    with pytest.raises(ValueError), common.scratch() as keep:
        keep(common.materialize(one, "failed"))
        raise ValueError
    assert len(list(folder.glob("*"))) == 1
