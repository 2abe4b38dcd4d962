import random
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions.parse import profile_name
from tessera.operators import models
from tessera.plans.linkage import Settings, evaluate, link

STREETS = "oak elm maple cedar birch walnut spruce willow".split()
FIRST = "acme global delta union summit pioneer royal golden silver bright rapid modern".split()
SECOND = "trading foods motors textiles pharma logistics plastics printing".split()


def noisy(rng, name, addr):
    if rng.random() < 0.4:
        name = name.replace(" Limited", rng.choice([" Ltd", " Ltd.", ""]))
    if rng.random() < 0.3:
        i = rng.randrange(len(name) - 1)
        name = name[:i] + name[i + 1 :]
    if rng.random() < 0.4:
        addr = addr.replace("Street", "St")
    if rng.random() < 0.15:
        addr = ""
    return name, addr


def world(spark, seed=1, n=80):
    rng = random.Random(seed)
    names = rng.sample([f"{a} {b} Limited" for a in FIRST for b in SECOND], n)
    rec, truth, uid = [], [], n
    for i, name in enumerate(names):
        addr = f"{rng.randrange(1, 200)} {rng.choice(STREETS)} Street, Springfield {10000 + i}"
        rec.append((i, f"S1-{i}", name, addr, "US", 1, profile_name("US")))
        for src in (2, 3):
            if rng.random() < 0.7:
                nm, ad = noisy(rng, name, addr)
                rec.append((uid, f"S{src}-{uid}", nm, ad, "US", src, "us"))
                truth.append((i, uid))
                uid += 1
    for _ in range(30):
        rec.append((uid, f"S2-{uid}", f"{rng.choice(STREETS)} {rng.choice(FIRST)} shop", f"{rng.randrange(300, 400)} {rng.choice(STREETS)} Street", "US", 2, "us"))
        uid += 1
    r = spark.createDataFrame(rec, "uid long, eid string, name_raw string, addr_raw string, country string, src int, prof string")
    t = spark.createDataFrame(truth, "s1_uid long, rec_uid long")
    counts = t.groupBy("s1_uid").agg(F.count("*").alias("n_true"))
    e = r.where("src = 1").select(F.col("uid").alias("s1_uid"), "eid", "country", "prof", (F.col("uid") % 2).cast("int").alias("fold")).join(counts, "s1_uid", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    return r, e, t


def test_train_and_apply(spark, tmp_path):
    s = Settings(n_folds=2, trees=4, depth=3, grid={"kappa": [0.9, 1.0], "t_min": [0.3], "delta": [-0.2, 0.0]}, top_forward=5, top_reverse=2, rounds=2, bags=2, expand=True, scorers=(models.lexical_scorer("s_text", "r_text"),) * 2, band=(0.05, 0.95))
    records, entities, truth = world(spark)
    matches, candidates, bundle = link(records, entities, truth, s=s)
    matches = matches.cache()
    all_ = {(r.slice, r.value): r for r in evaluate(matches, entities, truth).collect()}[("all", "")]
    assert all_.macro_f05 > 0.75
    assert matches.groupBy("rec_uid").count().where("count > 1").isEmpty()  # one owner
    assert matches.join(candidates, ["s1_uid", "rec_uid"], "left_anti").isEmpty()
    from tessera.plans import bundle as bundles

    bundles.save(spark, bundle, str(tmp_path / "bundle"))
    bundle = bundles.load(spark, str(tmp_path / "bundle"))
    assert bundle.countries == ["US"] and bundle.rounds[1][0].features.count("ce") == 1 and {"a1_cos", "n1_cos", "hop2"} <= set(bundle.pre.features)
    assert len(bundle.gate.features) == 17
    again, fresh, no_truth = world(spark, seed=2)
    found, _, _ = link(again, fresh.withColumn("fold", F.lit(-1)), None, bundle, s)
    unseen = {(r.slice, r.value): r for r in evaluate(found, fresh, no_truth).collect()}[("all", "")]
    assert unseen.macro_f05 > 0.7
    found, _, _ = link(again, fresh.withColumn("fold", F.lit(-1)), None, bundle, replace(s, rule="expected"))
    by_rule = {(r.slice, r.value): r for r in evaluate(found, fresh, no_truth).collect()}[("all", "")]
    assert by_rule.macro_f05 > 0.7


def test_functions_in_sql(spark):
    from tessera.functions.registry import register

    assert "t_jaro_winkler" in register(spark, "t_")
    r = spark.sql("select t_jaro_winkler('martha', 'marhta') a, t_token_set_ratio('a b', 'b') b, t_clean('É') c, t_parse_name('Acme Ltd', 'us').legal d, t_tokens('a-b') e, t_skeleton(null) f").first()
    assert (round(r.a, 6), r.b, r.c, r.d, r.e, r.f) == (0.961111, 1.0, "e", "ltd", ["a", "b"], None)
