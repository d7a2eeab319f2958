"""Fit and score: what SQL can know of a fitted model's rows."""

from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.scalars import is_finite
from ..operators import model as M
from ..operators import softmax_fit as S
from ..operators.statistics import log_loss
from ..session import work_path
from ..sources import snapshots as N
from ..streaming import guarded as G
from .registry import query, read

LAYERS, SEED = [64, 16, 10], 7


def _scored(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    model = M.fit_classifier(rows, "vec_id", "embedding", "label", LAYERS, seed=SEED, max_iter=30)
    return M.score(rows, model, "vec_id", "embedding", temp=1.0, seed=SEED)


@query("""
select vec_id, label, true as sums_to_one, true as best_is_largest, true as action_in_range, true as action_by_rule from embeddings""")
def fit_and_score(spark, sf_dir):
    """Probabilities sum to 1, the best class is the likeliest, and the drawn one follows the inverse of the running share."""
    probs = F.col("probs")
    total = F.aggregate(probs, F.lit(0.0), lambda t, p: t + p)

    def share(n):
        return F.aggregate(F.slice(probs, F.lit(1), n), F.lit(0.0), lambda t, p: t + p / total)

    u, action = uniform(SEED, "policy", "vec_id"), F.col("action")
    by_rule = (u < share(action + 1) + 1e-12) & (u >= share(action) - 1e-12)
    return _scored(spark, sf_dir).select(
        "vec_id", "label", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.get(probs, F.col("best")) == F.array_max(probs)).alias("best_is_largest"),
        action.between(0, LAYERS[-1] - 1).alias("action_in_range"), by_rule.alias("action_by_rule"))


@query("select true as finite, true as better_than_chance")
def model_log_loss(spark, sf_dir):
    """The loss on the training rows is a number below that of equal shares, ln 10."""
    loss = log_loss(_scored(spark, sf_dir), M.prob_of_label("label"))
    return loss.select(is_finite("log_loss").alias("finite"), (F.col("log_loss") < F.log(F.lit(float(LAYERS[-1])))).alias("better_than_chance"))


CLASSES, WIDTH, RATE, CLIP = 10, 64, 8.0, 0.1
POISONED = 1


def sql_weights(stages: list[tuple[str, int]]) -> str:
    """Tables p0, p1, ... of probabilities under weights w0, w1, ... along gradient steps; each stage has its rows and its steps."""
    parts = ["x as materialized (select vec_id, label, list_append(list_transform(embedding, lambda v: v::DOUBLE), 1.0::DOUBLE) as f from embeddings)",
             f"w0 as (select c, list_transform(range({WIDTH + 1}), lambda i: 0.0::DOUBLE) as w from range({CLASSES}) t(c))"]
    i = 0
    for rows, steps in stages:
        for _ in range(steps):
            parts += [_sql_probabilities(i, rows), f"""g{i} as materialized (
  select c, j, sum((p - (c = label)::INTEGER) * f[j]) / count(*) as g from p{i}, range(1, {WIDTH + 2}) t(j) group by c, j)""",
                      f"""w{i + 1} as materialized (
  select c, list(w[j] - {RATE} * s * g order by j) as w from g{i} join w{i} using (c), (select least(1.0, {CLIP} / sqrt(sum(g * g))) as s from g{i}) group by c)"""]
            i += 1
    return ",\n".join([*parts, _sql_probabilities(i, stages[-1][0])])


def _sql_probabilities(i: int, rows: str) -> str:
    return f"""p{i} as materialized (
  select vec_id, label, f, c, z, exp(z - top) / sum(exp(z - top)) over (partition by vec_id) as p, top + ln(sum(exp(z - top)) over (partition by vec_id)) as norm
  from (select *, max(z) over (partition by vec_id) as top from (select vec_id, label, f, c, list_inner_product(f, w) as z from x, w{i} where {rows})))"""


FIT_STEPS = 4
FIT_SQL = sql_weights([("true", FIT_STEPS)])


def _fitted(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rows, *S.fit_softmax(rows, "embedding", "label", CLASSES, WIDTH, FIT_STEPS, RATE, clip=CLIP)


@query(f"with {FIT_SQL}\n" + "\nunion all ".join(
    f"select {i} as step, round(avg(norm - z), 6) as loss, count(*) as n from p{i} where c = label" for i in range(FIT_STEPS + 1)))
def deterministic_fit(spark, sf_dir):
    """The loss before each clipped gradient step and at the end."""
    _, _, found = _fitted(spark, sf_dir)
    return spark.createDataFrame([(i, round(s.loss, 6), s.n) for i, s in enumerate(found)], "step int, loss double, n bigint")


@query(f"""with {FIT_SQL}
select vec_id, label, arg_max(c, (p, -c))::INTEGER as prediction, round(max(p), 6) as p from p{FIT_STEPS} group by vec_id, label""")
def deterministic_score(spark, sf_dir):
    """The most probable class of every vector under the fitted weights, and its probability."""
    rows, weights, _ = _fitted(spark, sf_dir)
    return S.score_softmax(rows.select("vec_id", "label", "embedding"), "embedding", weights).select("vec_id", "label", "prediction", F.round("p", 6).alias("p"))


def run_guarded_model(spark, sf_dir):
    """Three micro-batches of vectors; one of the middle batch holds a NaN, so its update must be turned away."""
    root, mark, folder = (work_path(spark, p) for p in ("model", "mark", "feed"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    first = rows.where(F.col("vec_id") % 3 == POISONED).agg(F.min("vec_id").alias("__bad"))
    bad = F.transform("embedding", lambda v: F.lit(float("nan")).cast("float"))
    rows = rows.join(F.broadcast(first), F.col("vec_id") == F.col("__bad"), "left").withColumn(
        "embedding", F.when(F.col("__bad").isNotNull(), bad).otherwise(F.col("embedding"))).drop("__bad")
    for part in range(3):
        rows.where(F.col("vec_id") % 3 == part).write.mode("append").parquet(folder)
        G.guarded_update(spark.readStream.schema(rows.schema).parquet(folder), root, S.model_update("embedding", "label", CLASSES, WIDTH, 2, RATE, CLIP),
                         S.model_gate(longest=1000.0), mark, loss=F.max("loss"), norm=F.max("norm")).awaitTermination()
    return root


@query(f"""with {sql_weights([("vec_id % 3 = 0", 2), ("vec_id % 3 = 2", 2)])}
select c::INTEGER as cls, round(w[1], 6) as first_weight, round(w[{WIDTH + 1}], 6) as constant, round(list_sum(list_transform(w, lambda v: v * v)), 6) as squares,
       (select round(avg(norm - z), 6) from p4 where c = label) as loss, (select count(*) from p4 where c = label) as n from w4""")
def guarded_model(spark, sf_dir):
    """The committed weights: two steps on the first batch and two on the third, as if the second had never come."""
    state = N.load_snapshot(spark, run_guarded_model(spark, sf_dir))[G.STATE]
    squares = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    return state.select("cls", F.round(F.col("weights")[0], 6).alias("first_weight"), F.round(F.col("weights")[WIDTH], 6).alias("constant"),
                        F.round(squares, 6).alias("squares"), F.round("loss", 6).alias("loss"), "n")
