from pyspark.sql import functions as F

from tessera.sources import tsv, validate


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def world(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry"
    p = [
        write(tmp_path / "s1.tsv", [head, "S1-2\tBeta \"Inc\"\t2 Side St\tUS", "S1-1\tAcme\t1 Main St\tUS "]),
        write(tmp_path / "s2.tsv", [head, "S2-1\tACME LLC\t1 main\tUS", "S2-2\tshort", "S2-3\ta\tb\tUS\textra"]),
        write(tmp_path / "s3.tsv", [head, "S3-1\tacme\t\tFrance"]),
    ]
    return tsv.ingest(spark, p), write(tmp_path / "truth.tsv", ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1, S3-1,S2-1", "S1-2\t"])


def test_ingest_and_truth(spark, tmp_path):
    rec, path = world(spark, tmp_path)
    got = {r.eid: r for r in rec.collect()}
    assert [e for e, _ in sorted(((r.eid, r.uid) for r in got.values()), key=lambda x: x[1])] == ["S1-1", "S1-2", "S2-1", "S2-2", "S2-3", "S3-1"]
    assert got["S1-2"].name_raw == 'Beta "Inc"' and got["S2-2"].addr_raw == "" and got["S2-3"].country == "US" and got["S3-1"].prof == "france"
    truth = tsv.read_truth(spark, path, rec)
    assert sorted(tuple(r) for r in truth.collect()) == [(0, 2), (0, 5)]
    ent = {r.eid: r.n_true for r in tsv.entities(rec, truth).collect()}
    assert ent == {"S1-1": 2, "S1-2": 0}
    assert {r.fold for r in tsv.entities(rec, None).collect()} == {-1}
    sample, kept = tsv.cluster_sample(rec, truth, 1.0)
    assert sample.count() == 6 and kept.count() == 2


def test_outputs_and_validator(spark, tmp_path):
    rec, path = world(spark, tmp_path)
    truth = tsv.read_truth(spark, path, rec)
    ent = tsv.entities(rec, truth)
    scored = truth.withColumn("q", F.col("rec_uid") / 10).withColumn("p_pre", F.col("q"))
    tsv.write_outputs(scored, scored, ent, rec, str(tmp_path / "out"))
    m = validate.lines(spark, str(tmp_path / "out/matching_results.tsv"))
    assert sorted(r.text for r in m.collect()) == ["S1-1\tS3-1,S2-1", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    c = validate.lines(spark, str(tmp_path / "out/candidate_pairs.tsv"))
    ids = ent.select(F.col("eid").alias("id"))
    assert validate.validate(m, c, ids).count() == 0
    try:
        tsv.write_outputs(scored.union(scored.select(F.lit(1), F.lit(2), F.lit(1.0), F.lit(1.0))), scored, ent, rec, str(tmp_path / "no"))
        raise AssertionError("not refused")
    except ValueError:
        pass


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line long, text string")


def test_each_fault(spark):
    good = rows(spark, ["source1_entity_id\tcandidate_entity_ids", "S1-1\tS2-1,S2-2,S3-1", "S1-2\t"])
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    head = "source1_entity_id\tmatched_entity_ids"
    cases = {
        "comma header": ["source1_entity_id,matched_entity_ids", "S1-1\t", "S1-2\t"],
        "wrong header": ["id\tlist", "S1-1\t", "S1-2\t"],
        "row without tab": [head, "S1-1", "S1-2\t"],
        "duplicate entity row": [head, "S1-1\t", "S1-1\tS2-1", "S1-2\t"],
        "duplicate id in a list": [head, "S1-1\tS2-1,S2-1", "S1-2\t"],
        "reference id in a list": [head, "S1-1\tS1-2", "S1-2\t"],
        "foreign prefix": [head, "S1-1\tX-2", "S1-2\t"],
        "missing entity": [head, "S1-1\tS2-1"],
        "unknown entity": [head, "S1-1\t", "S1-2\t", "S1-3\t"],
    }
    for rule, lines in cases.items():
        f = validate.validate(rows(spark, lines), good, ids)
        assert rule in {r.rule for r in f.where("level = 'error'").collect()}, rule
        assert not validate.passed(f)
    warned = validate.validate(rows(spark, [head, "S1-1\tS2-9", "S1-2\t"]), good, ids)
    assert [(r.rule, r.level) for r in warned.collect()] == [("match is not a candidate", "warning")] and validate.passed(warned)
    known = spark.createDataFrame([("S2-1",), ("S2-2",)], "id string")
    assert "unknown id in a list" in {r.rule for r in validate.validate(good, good, ids, known).collect()}
