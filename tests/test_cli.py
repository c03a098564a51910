"""Command lines over small files."""

import json

import pytest

from kithline import cli
from kithline.plans import flows
from tests.test_flows import bundle


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


@pytest.fixture
def files(spark, tmp_path):
    data = bundle(spark, tmp_path)
    sources = [x for i in (1, 2, 3) for x in (f"--source{i}", f"file://{tmp_path}/s{i}.tsv")]
    return data, f"file://{tmp_path}", sources, [*sources, "--truth", f"file://{tmp_path}/truth.tsv"]


def test_native_script(spark):
    from kithline.operators import audit

    rows = spark.createDataFrame([("Acme",), ("Café",), ("कमल",), ("12 ₹",)], "n string").selectExpr(f"{audit.native_script('n')} as x")
    assert [r.x for r in rows.collect()] == [False, True, True, False]


def test_rules_evaluate_and_validate(files, capsys):
    _, root, sources, every = files
    assert cli.main(["rules", *sources, "--out", f"{root}/r"]) == 0
    assert cli.main(["evaluate", "--truth", f"{root}/truth.tsv", "--predictions", f"{root}/r", "--source1", f"{root}/s1.tsv"]) == 0
    whole, us = said(capsys)
    assert whole["entities"] == us["entities"] == 12 and whole["pair_recall"] > 0.6 and us["country"] == "US"
    assert cli.main(["blocks", *every]) == 0
    assert said(capsys)[0]["true_links"] == 18
    assert cli.main(["audit", *every]) == 0
    rows = {(r["section"], r["item"]): r["value"] for r in said(capsys)}
    assert rows["S1", "rows"] == "12" and rows["truth", "s2_matches"] == "12" and rows["matches", "multiple"] == "6"
    # a single file, as the validator reads it
    matching = "source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i}\n" for i in range(12))
    folder = root.removeprefix("file://")
    for text, code in ((matching, 0), (matching.replace("S1-3\t", "S1-77\t"), 1)):
        with open(f"{folder}/m.tsv", "w") as f:
            f.write(text)
        assert cli.main(["validate", f"{root}/m.tsv", "--source1", f"{root}/s1.tsv", "--check-ids", f"{root}/s2.tsv", f"{root}/s3.tsv"]) == code


def test_split_and_pilot(files, capsys):
    _, root, _, every = files
    assert cli.main(["split", *every, "--out", f"{root}/split", "--dev", "2"]) == 0
    assert sum(r["entities"] for r in said(capsys)) == 12
    assert cli.main(["pilot", *every, "--out", f"{root}/p", "--size", "6", "--prepare-only"]) == 0
    first = said(capsys)
    assert cli.main(["pilot", *every, "--out", f"{root}/p", "--size", "6"]) == 0
    again = said(capsys)
    assert first[0] == again[0] and first[0]["pilot_size"] == 6 and len(first[0]["manifest_sha256"]) == 64
    assert {r["grp"] for r in again if "grp" in r} >= {"all", "country:US"} and any("family" in r for r in again)


def test_pools_model_and_sweep(spark, files, capsys):
    data, root, sources, every = files
    assert cli.main(["pools", *sources, "--out", f"{root}/pools", "-k", "5"]) == 0
    with pytest.raises(Exception, match="below"):
        cli.main(["train", *every, "--pools", f"{root}/pools", "--features", f"{root}/f", "--out", f"{root}/model", "--least-oracle", "1.1"])
    assert cli.main(["train", *every, "--pools", f"{root}/pools", "--features", f"{root}/f", "--out", f"{root}/model", "--rounds", "2", "--least-oracle", "0.5"]) == 0
    signature = said(capsys)[0]["signature"]
    assert cli.main(["score-pools", *sources, "--pools", f"{root}/pools", "--model", f"{root}/model", "--out", f"{root}/o", "--signature", signature]) == 0
    assert "12 12" in capsys.readouterr().out
    with pytest.raises(ValueError, match="not the one"):
        cli.main(["score-pools", *sources, "--pools", f"{root}/pools", "--model", f"{root}/model", "--out", f"{root}/o2", "--signature", "x"])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        cli.main(["score-pools", *sources, "--pools", f"{root}/pools", "--model", f"{root}/model", "--out", f"{root}/o"])
    assert cli.main(["k-sweep", *every, "--pools", f"{root}/pools", "--model", f"{root}/model", "--features", f"{root}/f", "--cutoffs", "1", "5"]) == 0
    assert [r["cutoff"] for r in said(capsys)] == [1, 5]
    assert cli.main(["rerank", *every, "--pools", f"{root}/pools"]) == 0
    got = said(capsys)
    assert {r["ranking"] for r in got} == {"retrieval", "name", "name_address"} and all(r["hits"] <= r["true_links"] for r in got)
    assert cli.main(["ablation", *every]) == 0
    assert {r["mode"] for r in said(capsys)} == set(flows.MODES)
    assert cli.main(["examples", *every]) == 0
    assert any("name_similarity" in r for r in said(capsys))
    pools = flows.load_pools(spark, f"{root}/pools")
    assert flows.materialized(data, pools, f"{root}/records").count() == pools.select("candidate_id").distinct().count()
    with pytest.raises(flows.CacheMismatch, match="these pools"):
        flows.cached_features(data, pools.where("rank <= 2"), f"{root}/f")
