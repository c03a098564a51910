"""Flows from files to files, and micro-batch linkage."""

from kithline.plans import flows
from kithline.sources import tsv
from kithline.streaming.incremental import link_arrivals

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def bundle(spark, folder):
    rows = {1: [], 2: [], 3: []}
    for i in range(12):
        rows[1].append(f"S1-{i}\tStore Number{i}x Bakery\t{100 + i} Long{i}street Road\tUS")
        rows[2].append(f"S2-{i}\tStore Number{i}x Bakery Inc\t0{100 + i} Long{i}street Rd\tUS")
        if i % 2:
            rows[3].append(f"S3-{i}\tBakery Number{i}x\t{100 + i} Long{i}street\tUS")
    for s, lines in rows.items():
        (folder / f"s{s}.tsv").write_text(HEAD + "\n".join(lines) + "\n", encoding="utf-8")
    truth = "\n".join(f"S1-{i}\tS2-{i}" + (f",S3-{i}" if i % 2 else "") for i in range(12))
    (folder / "truth.tsv").write_text(f"source1_entity_id\tmatched_entity_ids\n{truth}\n", encoding="utf-8")
    return tsv.load_bundle(spark, *(f"file://{folder}/s{s}.tsv" for s in (1, 2, 3)), f"file://{folder}/truth.tsv")


def test_rule_flow(spark, tmp_path):
    data = bundle(spark, tmp_path)
    flows.rule_submission(data, f"file://{tmp_path}/out")
    got = {r[0]: r[1] for r in tsv.load_truth(spark, f"file://{tmp_path}/out").collect()}
    assert len(got) == 12 and all(f"S2-{i}" in got[f"S1-{i}"].split(",") for i in range(12))


def test_model_flow(spark, tmp_path):
    data = bundle(spark, tmp_path)
    pools = flows.candidate_pools(data, 5).cache()
    fitted = flows.train(data, pools, rounds=3, least_oracle=0.9)
    flows.model_submission(data, pools, fitted, f"file://{tmp_path}/m", candidates_path=f"file://{tmp_path}/c", strict=True)
    got = {r[0]: r[1] for r in tsv.load_truth(spark, f"file://{tmp_path}/m").collect()}
    assert len(got) == 12 and sum(f"S2-{i}" in got[f"S1-{i}"].split(",") for i in range(12)) >= 10
    assert tsv.load_tsv(spark, f"file://{tmp_path}/c", ["source1_entity_id", "candidate_entity_ids"]).count() == 12


def test_arrivals(spark, tmp_path):
    data = bundle(spark, tmp_path)
    data.source1.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(data.source1.schema).parquet(f"file://{tmp_path}/in")
    seen = {}
    query = link_arrivals(stream, data.source2.unionByName(data.source3), lambda rows, n: seen.update({r[0]: r[1] for r in rows.collect()}), f"file://{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert seen == {r[0]: r[1] for r in flows.rule_submission(data).collect()}
