"""Online learning along the event stream, and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions import numeric as n
from driftloom.operators import frames, online
from driftloom.plans.registry import register
from driftloom.plans.tables import MATRIX, draw, matrix

_XS = ["one", "a", "b"]


def _input(spark, sf_dir) -> DataFrame:
    return matrix(spark, sf_dir).select("user_id", "row_id", F.lit(1.0).alias("one"), (F.col("f0") / 100).alias("a"), (F.col("f1") / 100).alias("b"), "label", "f1")


def _other_input(spark, sf_dir) -> DataFrame:
    """The second view of the stream."""
    return matrix(spark, sf_dir).select("user_id", "row_id", F.lit(1.0).alias("one"), (F.col("f2") / 10).alias("a"), (F.col("f3") / 5).alias("b"), "label")


#: The features of both views in SQL, and of the first widening along each stream: a feature more in each third.
_X, _Z = ("1.0", "f0 / 100", "f1 / 100"), ("1.0", "f2 / 10", "f3 / 5")
_widening = lambda xs: tuple(f"CASE WHEN 3 * (rn - 1) // c >= {i} THEN {x} END" for i, x in enumerate(xs))
#: Half of the labels are missing.
_HALF = f"CASE WHEN {draw('row_id')} % 2 = 0 THEN label END"


def _half(df: DataFrame) -> DataFrame:
    return df.withColumn("known", F.when(frames.draw(F.col("row_id"), F.lit(0)) % 2 == 0, F.col("label")))


def _ragged(df: DataFrame) -> DataFrame:
    """The three features as an array that gets longer in each third of a stream."""
    w = Window.partitionBy("user_id")
    third = F.floor(3 * (F.row_number().over(w.orderBy("row_id")) - 1) / F.count("*").over(w)).cast("int")
    return df.withColumn("xs", F.slice(F.array("one", "a", "b"), F.lit(1), third + 1))


def _walk_sql(schedule: int = 3, drift: bool = False, blend: float = 0.0, xs: tuple[str, ...] = _X, l1: float = 0.0, learn: str = "label", name: str = "o") -> str:
    """A recursive walk along each user's stream with the learner's state as columns, up to the table ``name``.

    ``learn``: what the learner is told; null only predicts. A null feature is one the row does not have.
    """
    three = range(3)
    told, kept = "ly IS NOT NULL", lambda new, old: f"CASE WHEN ly IS NOT NULL THEN {new} ELSE {old} END"
    w = [f"CASE WHEN abs(z{i}) <= {l1} THEN 0.0 ELSE -(z{i} - {l1} * sign(z{i})) / r END AS w{i}" for i in three]
    dec = n.decay(schedule, "t1")
    if drift:
        dec = f"CASE WHEN t1 > 30 THEN {dec} * (1 - {blend}) + {blend} * pi ELSE {dec} END"
    late = "t1 > 30" if drift else "false"
    lower, calm = f"({late} AND pi + si < pm + sm)", "(pi + si < pm1 + 2 * sm1)"
    reset = f"({late} AND NOT {calm} AND pi + si > pm1 + 3 * sm1)"
    new = [f"v{i} + (p - ly) * x{i}" for i in three], [f"dec * h{i} + w{i}" for i in three]
    state = [
        *(f"CASE WHEN {told} AND x{i} IS NOT NULL THEN {new[k][i]} ELSE {'vh'[k]}{i} END" for k in (0, 1) for i in three),
        *(f"CASE WHEN {told} AND x{i} IS NOT NULL THEN {new[0][i]} - ({new[1][i]}) ELSE z{i} END" for i in three),
        kept("1 + dec * r", "r"),
        kept(f"CASE WHEN {reset} THEN tw + 1 ELSE t1 END", "t"), kept(f"CASE WHEN {reset} THEN fw + e ELSE f1_ END", "fails"),
        kept(f"CASE WHEN NOT {late} THEN tw WHEN {reset} OR {calm} THEN 0.0 ELSE tw + 1 END", "tw"),
        kept(f"CASE WHEN NOT {late} THEN fw WHEN {reset} OR {calm} THEN 0.0 ELSE fw + e END", "fw"),
        kept(f"CASE WHEN {reset} THEN 1.0 ELSE pm1 END", "pm"), kept(f"CASE WHEN {reset} THEN 10.0 ELSE sm1 END", "sm"),
    ]
    first = {**{f"{c}{i}": 0.0 for c in "vhz" for i in three}, "r": 1.0, "t": 0.0, "fails": 0.0, "tw": 0.0, "fw": 0.0, "pm": 1.0, "sm": 10.0}
    return f"""
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM m),
{name}_s AS (SELECT user_id AS uid, rn, row_id, label::DOUBLE AS y, ({learn})::DOUBLE AS ly, {", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(xs))} FROM {name}_r),
{name}_w AS (
  SELECT DISTINCT uid, 0::BIGINT AS rn, 0::BIGINT AS row_id, 0.0::DOUBLE AS y, 0.0::DOUBLE AS u, 0.0::DOUBLE AS p, 0.0::DOUBLE AS loss, 1.0::DOUBLE AS decay,
    {", ".join(f"{v}::DOUBLE AS {k}" for k, v in first.items())} FROM {name}_s
  UNION ALL
  SELECT uid, rn, row_id, y, u, p, loss, {kept("dec", "NULL")}, {", ".join(state)}
  FROM (SELECT *, {dec} AS dec, CASE WHEN {lower} THEN pi ELSE pm END AS pm1, CASE WHEN {lower} THEN si ELSE sm END AS sm1
    FROM (SELECT *, f1_ / t1 AS pi, sqrt(greatest((f1_ / t1) * (1 - f1_ / t1), 0.0) / t1) AS si
      FROM (SELECT *, {kept("greatest(u, 0.0) - ly * u + ln(1 + exp(-abs(u)))", "NULL")} AS loss, t + 1 AS t1, fails + e AS f1_
        FROM (SELECT *, CASE WHEN abs(ly - p) > 0.5 THEN 1.0 ELSE 0.0 END AS e
          FROM (SELECT *, {n.sigmoid("u")} AS p
            FROM (SELECT *, {" + ".join(f"coalesce(w{i} * x{i}, 0.0)" for i in three)} AS u
              FROM (SELECT s.uid, s.rn, s.row_id, s.y, s.ly, s.x0, s.x1, s.x2, {", ".join(w)}, {", ".join(first)}
                FROM {name}_w AS w JOIN {name}_s AS s ON s.uid = w.uid AND s.rn = w.rn + 1)))))))),
{name} AS (SELECT uid AS user_id, row_id, y, u, p, loss, decay FROM {name}_w WHERE rn > 0)"""


def _learner_sql(*args, **more) -> str:
    return f"WITH RECURSIVE {MATRIX}, {_walk_sql(*args, **more)}\n"


_RUN = "OVER (PARTITION BY user_id ORDER BY row_id ROWS UNBOUNDED PRECEDING)"
_CER = f"round(avg(CASE WHEN abs(y - p) > 0.5 THEN 1.0 ELSE 0.0 END) {_RUN}, 6) AS cer"
_MSE = f"round(avg((p - y) * (p - y)) {_RUN}, 6) AS mse"


def _measured(out: DataFrame, *more) -> DataFrame:
    """Predictions and the error rate so far, against the true labels."""
    rate = online.cer(F.col("y"), F.col("p"), online.running("key", "row_id"))
    return out.select(F.col("key").alias("user_id"), "row_id", F.round("p", 6).alias("p"), F.round(rate, 6).alias("cer"), *more)


@register("online_cer", _learner_sql() + f"SELECT user_id, row_id, round(p, 6) AS p, {_CER} FROM o")
def online_cer(spark, sf_dir):
    """O1-O3, O6 (all labels known), W1: the learner over each user's events, and its error rate so far."""
    return _measured(online.replay(_input(spark, sf_dir), "user_id", "row_id", _XS, "label"))


@register("online_masked", _learner_sql(learn=_HALF) + f"SELECT user_id, row_id, round(p, 6) AS p, {_CER}, round(decay, 6) AS decay FROM o")
def online_masked(spark, sf_dir):
    """Half of the labels are missing; their rows are predicted only, and measured like all."""
    out = online.replay(_half(_input(spark, sf_dir)), "user_id", "row_id", _XS, "label", "known")
    return _measured(out, F.round("decay", 6).alias("decay"))


_FILLED = f"coalesce({_HALF}, CASE WHEN f1 > 60 THEN 1 ELSE 0 END)"


@register("online_filled", _learner_sql(learn=_FILLED, schedule=2) + f"SELECT user_id, row_id, round(p, 6) AS p, {_CER}, {_MSE} FROM o")
def online_filled(spark, sf_dir):
    """O6 on filled labels, O3 (third schedule): missing labels are filled by a rule and learned from; measured against the true ones."""
    rows = _half(_input(spark, sf_dir)).withColumn("filled", F.coalesce("known", (F.col("f1") > 60).cast("int")))
    out = online.replay(rows, "user_id", "row_id", _XS, "label", "filled", schedule=2)
    return _measured(out, F.round(online.cumulative_mse(F.col("y"), F.col("p"), online.running("key", "row_id")), 6).alias("mse"))


@register("online_ragged", _learner_sql(xs=_widening(_X), learn=_HALF) + f"SELECT user_id, row_id, round(p, 6) AS p, {_CER} FROM o")
def online_ragged(spark, sf_dir):
    """Rows that get wider along the stream, half of them without label."""
    return _measured(online.replay(_ragged(_half(_input(spark, sf_dir))), "user_id", "row_id", "xs", "label", "known"))


def _first_seven_tenths() -> Column:
    """Of rows with rn and c, in whole numbers as SQL's decimals: 0.7 * 90 is below 63 as a double."""
    return F.expr("rn <= 7 * c div 10")


_EARLY = "CASE WHEN rn <= floor(0.7 * c) THEN label END"


@register("online_predict", _learner_sql(learn=_EARLY) + "SELECT user_id, row_id, round(p, 6) AS p FROM o JOIN o_r USING (user_id, row_id) WHERE rn > floor(0.7 * c)")
def online_predict(spark, sf_dir):
    """Learned on the first seven tenths of each stream, then its state predicts the rest in the JVM."""
    w = Window.partitionBy("user_id")
    rows = _input(spark, sf_dir).withColumns({"rn": F.row_number().over(w.orderBy("row_id")), "c": F.count("*").over(w)})
    early = _first_seven_tenths()
    states = online.learned(rows.where(early), "user_id", "row_id", _XS, "label")
    late = rows.where(~early).join(states.withColumnRenamed("key", "user_id"), "user_id", "left")
    p = F.coalesce(online.predict(F.col("state"), F.array(*_XS)), F.lit(0.5))  # a stream too short to learn from knows nothing
    return late.select("user_id", "row_id", F.round(p, 6).alias("p"))


@register("online_drift", _learner_sql(4, True, 0.02) + "SELECT user_id, row_id, round(p, 6) AS p, round(decay, 6) AS decay FROM o")
def online_drift(spark, sf_dir):
    """The decay blended with the error rate from row 31 on, warnings and resets on drift."""
    out = online.replay(_input(spark, sf_dir), "user_id", "row_id", _XS, "label", schedule=4, blend=0.02, drift=True)
    return out.select(F.col("key").alias("user_id"), "row_id", F.round("p", 6).alias("p"), F.round("decay", 6).alias("decay"))


@register("online_sparse", _learner_sql(1, l1=0.4) + "SELECT user_id, row_id, round(p, 6) AS p FROM o")
def online_sparse(spark, sf_dir):
    """O1 with a threshold: weights of weak features stay zero."""
    out = online.replay(_input(spark, sf_dir), "user_id", "row_id", _XS, "label", schedule=1, l1=0.4)
    return out.select(F.col("key").alias("user_id"), "row_id", F.round("p", 6).alias("p"))


@register("online_mse", _learner_sql(0) + f"SELECT user_id, row_id, {_MSE}, round(loss, 6) AS loss FROM o")
def online_mse(spark, sf_dir):
    """Cumulative squared error in one pass, and the logistic loss of each row."""
    out = online.replay(_input(spark, sf_dir), "user_id", "row_id", _XS, "label", schedule=0)
    mse = online.cumulative_mse(F.col("y"), F.col("p"), online.running("key", "row_id"))
    return out.select(F.col("key").alias("user_id"), "row_id", F.round(mse, 6).alias("mse"), F.round("loss", 6).alias("loss"))


def _ensemble_sql(x: tuple[str, ...], z: tuple[str, ...], learn: str, only_told: bool = False) -> str:
    w = "OVER (PARTITION BY user_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    u = "(lam * ux + (1 - lam) * uz)"
    m = MATRIX if not only_told else MATRIX.replace("m AS (", "all_ AS (", 1) + f", m AS (SELECT * FROM all_ WHERE {learn} IS NOT NULL)"
    return f"""WITH RECURSIVE {m}, {_walk_sql(xs=x, learn=learn)}, {_walk_sql(xs=z, learn=learn, name="o2")},
e AS (SELECT o.user_id, o.row_id, o.u AS ux, o2.u AS uz, o.loss AS lx, o2.loss AS lz FROM o JOIN o2 USING (user_id, row_id)),
f AS (SELECT *, 1 / (1 + exp(0.001 * coalesce(sum(lx - lz) {w}, 0))) AS lam FROM e)
SELECT user_id, row_id, round(lam, 6) AS lam, round({n.sigmoid(u)}, 6) AS p FROM f"""


def _ensemble(x: DataFrame, z: DataFrame, features, learn_from: str) -> DataFrame:
    both = online.ensemble(*(online.replay(v, "user_id", "row_id", features, "label", learn_from) for v in (x, z)))
    return both.select(F.col("key").alias("user_id"), "row_id", F.round("lam", 6).alias("lam"), F.round("p", 6).alias("p"))


@register("online_ensemble", _ensemble_sql(_X, _Z, "label"))
def online_ensemble(spark, sf_dir):
    """Two views of one stream, weighted by the losses before each row."""
    return _ensemble(_input(spark, sf_dir), _other_input(spark, sf_dir), _XS, "label")


@register("online_ensemble_masked", _ensemble_sql(_X, _Z, _HALF))
def online_ensemble_masked(spark, sf_dir):
    """Half of the labels are missing; their rows are predicted by both views and leave the weight as it is."""
    return _ensemble(_half(_input(spark, sf_dir)), _half(_other_input(spark, sf_dir)), _XS, "known")


@register("online_ensemble_ragged", _ensemble_sql(_widening(_X), _widening(_Z), _HALF))
def online_ensemble_ragged(spark, sf_dir):
    """The same over rows that get wider."""
    return _ensemble(_ragged(_half(_input(spark, sf_dir))), _ragged(_half(_other_input(spark, sf_dir))), "xs", "known")


@register("online_ensemble_skipping", _ensemble_sql(_X, _Z, _HALF, only_told=True))
def online_ensemble_skipping(spark, sf_dir):
    """Rows with a missing label are left out, not predicted."""
    known = lambda df: _half(df).where("known is not null")
    return _ensemble(known(_input(spark, sf_dir)), known(_other_input(spark, sf_dir)), _XS, "known")


@register("online_holdout", f"""WITH {MATRIX}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM m)
SELECT user_id, count(*) FILTER (WHERE rn <= floor(0.7 * c)) AS train, count(*) FILTER (WHERE rn > floor(0.7 * c)) AS test FROM r GROUP BY user_id""")  # fmt: skip
def online_holdout(spark, sf_dir):
    """The first 70 % of each stream to learn from, the rest to test on."""
    w = Window.partitionBy("user_id")
    ranked = matrix(spark, sf_dir).select("user_id", F.row_number().over(w.orderBy("row_id")).alias("rn"), F.count("*").over(w).alias("c"))
    early = _first_seven_tenths()
    return ranked.groupBy("user_id").agg(F.count_if(early).alias("train"), F.count_if(~early).alias("test"))


_PAIRS = f"""WITH {MATRIX}, p AS (SELECT label AS y, CASE WHEN f1 > 60 THEN 1 ELSE 0 END AS q FROM m), c AS (SELECT y, q, count(*) AS n FROM p GROUP BY y, q),
t AS (SELECT v.y AS k, coalesce((SELECT sum(n) FROM c WHERE y = k AND q = k), 0) AS tp, (SELECT sum(n) FROM c WHERE q = k) AS pred, coalesce((SELECT sum(n) FROM c WHERE c.y = k), 0) AS real
  FROM (SELECT DISTINCT q AS y FROM c) v),
u AS (SELECT *, coalesce(tp / nullif(pred, 0), 0) AS pr, coalesce(tp / nullif(real, 0), 0) AS re FROM t)
SELECT round((SELECT sum(n) FROM c WHERE y = q) / (SELECT sum(n) FROM c), 6) AS accuracy, round(sum(pr * real) / sum(real), 6) AS precision, round(sum(re * real) / sum(real), 6) AS recall,
  round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * real) / sum(real), 6) AS f1 FROM u"""


@register("classification_scores", _PAIRS)
def classification_scores(spark, sf_dir):
    """Accuracy and weighted precision, recall and F1 over the predicted labels, from a confusion table."""
    c = matrix(spark, sf_dir).groupBy(F.col("label").alias("y"), (F.col("f1") > 60).cast("int").alias("q")).agg(F.count("*").alias("n"))
    by_q = c.groupBy(F.col("q").alias("k")).agg(F.sum("n").alias("pred"), F.sum(F.when(F.col("y") == F.col("q"), F.col("n")).otherwise(0)).alias("tp"))
    t = by_q.join(c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("real")), "k", "left").na.fill({"real": 0})
    pr, re = F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "real"), F.lit(0.0))
    t = t.select("real", pr.alias("pr"), re.alias("re"), "k")
    f1 = F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), F.lit(0.0))
    mean = lambda x: F.round(F.sum(x * F.col("real")) / F.sum("real"), 6)
    right = c.agg(F.round(F.sum(F.when(F.col("y") == F.col("q"), F.col("n")).otherwise(0)) / F.sum("n"), 6)).scalar()
    return t.agg(mean(F.col("pr")).alias("precision"), mean(F.col("re")).alias("recall"), mean(f1).alias("f1")).withColumn("accuracy", right)
