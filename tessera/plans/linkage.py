"""The whole linkage task as one plan: parse, block, rank, compare, score, calibrate, select; training and inference share it.

Every step is a DataFrame; the long ones are written to the shared checkpoint folder, where a lost executor's work ends.
Learned parts are gathered in a ``Bundle`` that inference takes as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import NAMES, Weights, pair_features, token_weights
from tessera.functions.parse import EMPTY, Tables, normalize
from tessera.functions.similarity import token_set_ratio
from tessera.operators import blocking as B
from tessera.operators import collective, context, decide, metrics, mining, models
from tessera.runtime import cut


@dataclass(frozen=True)
class Settings:
    """Sizes and bounds of the task; the defaults are those of the full one."""

    top_forward: int = 30
    top_reverse: int = 3
    min_sim: float = 0.15
    floor: float = 0.002
    floor_low: float = 0.0005
    record_top: int = 2
    per_entity: int = 60
    sure: float = 0.8
    top_members: int = 8
    n_folds: int = 4
    trees: int = 20
    depth: int = 5
    rounds: int = 3  # of scoring; from the second on with collective features of the round before
    bags: int = 3  # models that a round's score is the mean of, from the second round on
    expand: bool = False  # two-hop expansion, where it lifts the ceiling
    sure_member: float = 0.9
    neighbours: int = 5
    neighbour_sim: float = 0.6
    per_entity_added: int = 10
    overrides: dict[str, dict[str, float]] = field(default_factory=dict)  # by profile, in place of tuned thresholds
    empty: tuple[str, ...] = ()  # profiles whose entities get no record: a probe
    shift: dict[str, float] = field(default_factory=dict)  # by profile, on the logit scale, before selection
    caps: dict[int, int] = field(default_factory=lambda: {2: 5, 3: 6})
    rule: str = "heuristic"  # or "expected": the prefix of the largest expected F0.5, which has no thresholds
    density: bool = True  # list sizes relative to the profile's usual list
    strip_levels: bool = True  # address components that name an administrative level go, in countries without truth
    scorers: tuple[models.Scorer, models.Scorer] | None = None  # of texts, cross-fitted halves: they see ``band`` between rounds 1 and 2
    band: tuple[float, float] = (0.02, 0.98)
    fine: dict[str, list[float]] = field(default_factory=lambda: {"kappa": [-0.05, 0.0, 0.05], "t_min": [-0.05, 0.0, 0.05], "delta": [0.0]})  # steps around the best of ``grid``
    grid: dict[str, list[float]] = field(default_factory=lambda: {"kappa": [0.8, 0.9, 1.0], "t_min": [0.3, 0.4, 0.5], "delta": [-0.1, 0.0, 0.1]})


@dataclass
class Bundle:
    """All that training learns."""

    tables: Tables = EMPTY
    name: Weights = Weights()
    addr: Weights = Weights()
    pre: models.FoldModels | None = None
    rounds: list[list[models.FoldModels]] = field(default_factory=list)
    calibrator: models.Calibrator | None = None
    gate: models.FoldModels | None = None
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    countries: list[str] = field(default_factory=list)  # with truth: one a country


CHEAP = ["name_ratio", "name_tsr", "addr_tsr", "num_hit", "pin_eq", "pin_diff", "legal_eq", "rec_addr_missing", "rec_script", "rec_is_domain", "rec_src", "s1_ncand", "rec_ncand", "s1_name_freq", "s1_addr_share", "n1f_rank", "n1r_rank", "n1_sim", "a1f_rank", "a1r_rank", "a1_sim", "a1_cos", "n1_cos", "hop2", "key_block", "key_n", *[f"key_{k}" for k in B.KEY_KINDS]]
CONTEXT = [f"c1_{x}" for x in ("s1_rank", "rec_rank", "s1_gap", "rec_gap", "s1_other", "rec_comp", "s1_share", "rec_share", "s1_n", "rec_n", "s1_n50", "rec_n50", "rec_margin")]
CONSENSUS = [f"cons_{x}" for x in ("n", "name_max", "name_mean", "addr_max", "addr_mean", "numhit_rate", "num_agree", "pin_agree", "is_member")]
COMPETITION = [f"cm_{x}" for x in ("own_src_n", "own_cap_left", "own_empty", "comp_has", "comp_n", "comp_src_n", "comp_cap_left", "comp_empty", "n_close", "n_diff")]
GATE = ["g_top1", "g_top2", "g_top3", "g_gap12", "g_sum", "g_n03", "g_n05", "g_n08", "g_n_owned", "g_ncand", "g_p2max", "g_top1_comp", "g_best_name", "g_best_addr", "g_best_numhit", "s1_name_freq", "s1_addr_share"]


def channels(norm: DataFrame) -> dict[str, DataFrame]:
    """Sparse rows by channel: a1 of addresses, n1 of names with addresses at half weight."""
    by = ("country",)
    name = cut(B.tfidf(norm.select("country", "uid", F.when(F.col("name_core") != "", F.col("name_core")).otherwise(F.col("name_latin")).alias("t")), "uid", "t", by))
    addr = cut(B.tfidf(norm.where(~F.col("addr_missing")).select("country", "uid", F.regexp_replace("addr_latin", ",", " ").alias("t")), "uid", "t", by))
    return {"n1": cut(B.combined(name, addr, by)), "a1": addr}


def candidates(norm: DataFrame, s: Settings, rows: dict[str, DataFrame], dense: DataFrame | None = None) -> DataFrame:
    """Pairs of key blocks and of exact top-k joins of each channel, in both directions, within a country.

    ``dense`` (country, uid, vec), embeddings made elsewhere, is a third channel (d1).
    """
    by = ("country",)
    ref = norm.select("uid", (F.col("src") == 1).alias("ref"))
    hits = []
    for channel, r in {**rows, **({} if dense is None else {"d1": dense})}.items():
        q, i = (r.join(ref.where(c).select("uid"), "uid", "left_semi") for c in ("ref", "not ref"))
        for direction, a, b, k in (("f", q, i, s.top_forward), ("r", i, q, s.top_reverse)):
            h = B.dense_topk(a, b, k, by=by, min_sim=s.min_sim) if channel == "d1" else B.sparse_topk(a, b, k, s.min_sim, by)
            names = {"query": "s1_uid", "item": "rec_uid"} if direction == "f" else {"query": "rec_uid", "item": "s1_uid"}
            hits.append(h.withColumnsRenamed(names).select(F.lit(channel).alias("channel"), F.lit(direction).alias("direction"), "s1_uid", "rec_uid", "rank", "sim"))
    return cut(B.candidate_union(B.union_all(hits), B.key_pairs(B.linkage_keys(norm))))


def ranked_features(pairs: DataFrame, norm: DataFrame, rows: dict[str, DataFrame], entities: DataFrame, truth: DataFrame | None, s: Settings) -> DataFrame:
    """Pairs with all that the first ranking model needs: both cosines, whatever channel found them, and the cheap features."""
    out = B.row_cosine(B.row_cosine(labelled(pairs, entities, truth), rows["a1"], out="a1_cos"), rows["n1"], out="n1_cos")
    out = B.cheap_features(out, norm)
    return cut(context.density_normalize(out, ["s1_ncand", "rec_ncand"], "prof") if s.density else out)


def expanded(scored: DataFrame, norm: DataFrame, entities: DataFrame, truth: DataFrame | None, s: Settings) -> DataFrame:
    """scored candidates with records near their confident members; with truth only if that lifts the ceiling.  hop2 tells them apart."""
    by = ("country",)
    sure = scored.where(F.col("p_pre") >= s.sure_member).select(F.col("rec_uid").alias("uid")).distinct()
    docs = norm.where("src <> 1").select("country", "uid", F.concat_ws(" ", "name_core", F.regexp_replace("addr_latin", ",", " ")).alias("t"))
    rows = cut(B.tfidf(docs, "uid", "t", by))
    near = B.sparse_topk(rows.join(sure, "uid", "left_semi"), rows, s.neighbours + 1, s.neighbour_sim, by).select(F.col("query").alias("m"), F.col("item").alias("n"), "sim")
    added = cut(B.two_hop(scored, near, score="p_pre", confident=s.sure_member, min_sim=s.neighbour_sim, max_add=s.per_entity_added))
    if truth is not None and not B.worth_expanding(entities, scored, added, truth):
        return scored.withColumn("hop2", F.lit(0))
    return B.union_all([scored.withColumn("hop2", F.lit(0)), added.select("s1_uid", "rec_uid", F.lit(1).alias("hop2"))])


def labelled(pairs: DataFrame, entities: DataFrame, truth: DataFrame | None) -> DataFrame:
    out = pairs.join(entities.select("s1_uid", "prof", "fold"), "s1_uid")
    if truth is None:
        return out
    return out.join(truth.select("s1_uid", "rec_uid", F.lit(1).alias("label")), ["s1_uid", "rec_uid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def second_opinion(scored: DataFrame, norm: DataFrame, s: Settings, learn: bool) -> DataFrame:
    """scored with ``ce``, the scorers' view of the texts of uncertain pairs; null for the others.

    In training a half of the entities is seen by the scorer that didn't learn from it, later every pair by both, and the mean counts.
    """
    text = norm.select("uid", F.concat_ws(" | ", "name_latin", "addr_latin").alias("text"))
    band = context.uncertain(scored.select("s1_uid", "rec_uid", "p1"), "p1", *s.band)
    band = band.join(text.select(F.col("uid").alias("s1_uid"), F.col("text").alias("s_text")), "s1_uid").join(text.select(F.col("uid").alias("rec_uid"), F.col("text").alias("r_text")), "rec_uid")
    half = context.hash_order("s1_uid") % 2
    seen = [band.where(half != h) if learn else band for h in (0, 1)]
    first, second = (models.score_pairs(b, scorer, ["s_text", "r_text"]).select("s1_uid", "rec_uid", "ce") for b, scorer in zip(seen, s.scorers))
    return scored.join(models.merge_halves(first, second), ["s1_uid", "rec_uid"], "left")


def collective_features(scored: DataFrame, norm: DataFrame, s: Settings, score: str) -> DataFrame:
    """scored with list context, consensus and competition of a score."""
    people = norm.select("uid", F.col("name_core").alias("name"), F.col("addr_latin").alias("addr"), F.col("num_primary").alias("num"), "nums", "pin")
    e = scored.select("s1_uid", "rec_uid", F.col(score).alias("p1"), "num_hit", F.col("rec_src").alias("src"))
    ctx = context.score_context(e.select("s1_uid", "rec_uid", "p1"), "p1", "c1").drop("p1")
    if s.density:
        ctx = context.density_normalize(ctx.join(scored.select("s1_uid", "rec_uid", "prof"), ["s1_uid", "rec_uid"]), ["c1_s1_n", "c1_rec_n"], "prof").drop("prof")
    cons = collective.consensus(e, people, lambda a, b: token_set_ratio(a, b), sure=s.sure, top=s.top_members)
    comp = collective.competition(e, sure=s.sure, top=s.top_members, caps=s.caps)
    keys = ["s1_uid", "rec_uid"]
    return scored.join(ctx, keys).join(cons, keys).join(comp, keys)


def link(records: DataFrame, entities: DataFrame, truth: DataFrame | None, bundle: Bundle | None = None, s: Settings = Settings(), dense: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Bundle]:
    """(matches, candidates, bundle).  With truth and no bundle it learns; with a bundle it only applies it.

    records: of ``sources.tsv.ingest``; entities: of ``sources.tsv.entities``; dense: optional embeddings (country, uid, vec).
    """
    learn = bundle is None
    if learn and truth is None:
        raise ValueError("without a bundle there must be truth to learn from")
    b = Bundle() if learn else bundle
    if learn:
        side = lambda key, n, a: records.select(F.col("uid").alias(key), F.col("name_raw").alias(n), F.col("addr_raw").alias(a))
        pairs = truth.join(side("s1_uid", "sn", "sa"), "s1_uid").join(side("rec_uid", "rn", "ra"), "rec_uid").join(records.select(F.col("uid").alias("s1_uid"), "prof"), "s1_uid")
        b.tables = mining.mine(pairs)
        b.countries = [r["country"] for r in records.join(truth.select(F.col("s1_uid").alias("uid")), "uid", "left_semi").select("country").distinct().collect()]  # one a country
    norm = normalize(records, b.tables)
    if s.strip_levels:
        norm = cut(norm)
        foreign = norm.where(~F.col("country").isin(b.countries))
        norm = mining.strip_components(norm, mining.admin_vocabulary(foreign))
    norm = cut(norm)
    if learn:
        b.name, b.addr = token_weights(norm, F.array_distinct(F.split("name_core", " "))), token_weights(norm, F.array_distinct("addr_tokens"))
    rows = channels(norm)
    pairs = ranked_features(candidates(norm, s, rows, dense).withColumn("hop2", F.lit(0)), norm, rows, entities, truth, s)
    if learn:
        b.pre = models.fit_folds(pairs, CHEAP, n_folds=s.n_folds, trees=s.trees, depth=s.depth)
    pre = b.pre.score(pairs, "p_pre")
    kept = cut(context.keep_rule(pre, "p_pre", s.floor, s.floor_low, s.record_top, s.per_entity))
    if s.expand:
        base = ["s1_uid", "rec_uid", "n1f_rank", "n1r_rank", "n1_sim", "a1f_rank", "a1r_rank", "a1_sim", "d1f_rank", "d1r_rank", "d1_sim", "key_mask", "key_block", "key_n"]
        grown = expanded(kept.select(*base, "p_pre"), norm, entities, truth if learn else None, s).drop("p_pre")
        kept = cut(b.pre.score(ranked_features(grown, norm, rows, entities, truth, s), "p_pre"))
    scored = cut(pair_features(kept, norm, b.name, b.addr))
    columns = list(dict.fromkeys(CHEAP + ["p_pre", "nm_lev", *NAMES]))
    for k in range(s.rounds):
        score, before = f"p{k + 1}", f"p{k}"
        if k == 1 and s.scorers:
            scored, columns = cut(second_opinion(scored, norm, s, learn)), [*columns, "ce"]
        if k:
            scored = cut(collective_features(scored.drop(*CONTEXT, *CONSENSUS, *COMPETITION), norm, s, before))
            columns = [c for c in columns if c not in {*CONTEXT, *CONSENSUS, *COMPETITION}] + [before, *CONTEXT, *CONSENSUS, *COMPETITION]
        if learn:
            b.rounds.append([models.fit_folds(scored, columns, n_folds=s.n_folds, trees=s.trees, depth=s.depth, seed=1 + i) for i in range(s.bags if k else 1)])
        for i, m in enumerate(b.rounds[k]):
            scored = m.score(scored, f"__b{i}")
        bag = [f"__b{i}" for i in range(len(b.rounds[k]))]
        scored = models.bag_mean(scored, bag, score).drop(*bag)
    last = f"p{s.rounds}"
    if learn:
        scored = cut(scored)
        b.calibrator = models.fit_calibrator(scored, last)
    scored = b.calibrator.apply(scored, last)
    if s.shift:
        by = F.create_map(*[F.lit(x) for kv in s.shift.items() for x in kv])
        scored = scored.withColumn("q", decide.logit_shift(F.col("q"), F.coalesce(F.try_element_at(by, F.col("prof")), F.lit(0.0))))
    scored = cut(context.one_owner(scored, "q").withColumn("src", F.col("rec_src")))
    extra = {"g_p2max": f"p{min(2, s.rounds)}", "g_best_name": "nm_tset", "g_best_addr": "ad_tset", "g_best_numhit": "num_hit"}
    gates = collective.gate_profile(scored.select("s1_uid", "rec_uid", "q", *extra.values()), entities, score="q", extra=extra).join(B.reference_stats(norm), "s1_uid", "left")
    if s.density:
        gates = context.density_normalize(gates, ["g_ncand", "g_n_owned"], "prof")
    if learn:
        gates = cut(gates.withColumn("label", (F.col("n_true") > 0).cast("int")))
        b.gate = models.fit_folds(gates, GATE, n_folds=s.n_folds, trees=s.trees, depth=s.depth)
    arrays = decide.member_arrays(scored, b.gate.score(gates, "g").select("s1_uid", "prof", "g"))
    if s.rule == "expected":
        chosen = decide.select_expected(arrays, caps=s.caps).join(arrays.select("s1_uid", "prof"), "s1_uid")
    else:
        if learn:
            arrays = cut(arrays)
            b.thresholds = tuned(arrays, truth, entities, s)
        use = thresholds(b, s)
        chosen = decide.select_heuristic(arrays.withColumns({f"__{k}": v for k, v in use.items()}), caps=s.caps, **{k: F.col(f"__{k}") for k in use})
    if s.empty:
        chosen = chosen.where(~F.col("prof").isin(*s.empty))
    matches = decide.picked_pairs(chosen).join(scored.select("s1_uid", "rec_uid", "q"), ["s1_uid", "rec_uid"])
    return matches, kept.select("s1_uid", "rec_uid", "p_pre"), b


def tuned(arrays: DataFrame, truth: DataFrame, entities: DataFrame, s: Settings) -> dict[str, dict[str, float]]:
    """Each profile's best thresholds on the coarse grid, then on the fine one around them."""
    best = {r["prof"]: {k: r[k] for k in s.grid} for r in decide.grid_search(arrays, truth, entities, s.grid, caps=s.caps).collect()}  # one row a profile
    for prof, at in best.items():
        around = {k: [at[k] + d for d in sorted(s.fine.get(k, [0.0]), key=abs)] for k in s.grid}  # no step first: ties stay
        own = decide.grid_search(arrays.where(F.col("prof") == prof), truth, entities, around, caps=s.caps).first()
        best[prof] = {k: own[k] for k in s.grid}
    return best


def thresholds(b: Bundle, s: Settings) -> dict:
    """Each profile's own thresholds; a profile without any takes those of the one of most data, the calibrator's fallback."""
    out = {}
    tuned = b.thresholds | s.overrides
    base = tuned.get(b.calibrator.fallback) or next(iter(tuned.values()))
    for k in s.grid:
        c = None
        for prof, t in tuned.items():
            c = F.when(F.col("prof") == prof, F.lit(float(t[k]))) if c is None else c.when(F.col("prof") == prof, F.lit(float(t[k])))
        out[k] = c.otherwise(F.lit(float(base[k])))
    return out


def evaluate(matches: DataFrame, entities: DataFrame, truth: DataFrame) -> DataFrame:
    return metrics.report(metrics.entity_scores(entities, matches, truth))
