"""Registered sampling / split / preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.operators import prep, routes, sampling
from punctual.plans import pipeline as PL
from punctual.plans.catalog import features, register
from punctual.plans.sql import q, r6
from punctual.schema import MODEL_FEATURES, TARGET
from punctual.sources.flights import ROW_KEY, flights

KEY_SQL = ", ".join(ROW_KEY)
KEY_COLS = list(ROW_KEY)
DELAYED_SAMPLE = 5000
SCATTER_SAMPLE = 15000
N_REQUESTS = 50


def _hash_order(seed: str) -> str:
    return f"md5(FlightKey || ':{seed}'), {KEY_SQL}"


_MODEL_SELECT = """SELECT FlightKey, FlightDate, CRSDepTime, TaxiOut, Airline, Origin, Dest, OriginAirportID,
       DestAirportID, Distance, CAST(least(floor(Distance / 250) + 1, 11) AS INT) AS DistanceGroup, Year, Month,
       MonthName, DayOfWeek, DayOfWeekName, CAST(dayofmonth(FlightDate) AS INT) AS DayofMonth,
       CAST(quarter(FlightDate) AS INT) AS Quarter, DepHour, DepTimeOfDay,
       CASE WHEN DepHour IS NOT NULL THEN printf('%02d00-%02d59', DepHour, DepHour) END AS DepTimeBlk, IsArrDelayed
FROM {src} WHERE Cancelled = 0 AND Diverted = 0 AND Airline IS NOT NULL AND Origin IS NOT NULL AND Dest IS NOT NULL"""

_PIPE = f""", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Year ORDER BY {_hash_order(PL.SEED)}) AS rn
               FROM features) WHERE rn <= {PL.SAMPLE_PER_YEAR}),
m AS ({_MODEL_SELECT.format(src='s')}),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY IsArrDelayed ORDER BY {_hash_order(PL.SPLIT_SEED)})
                       <= round({PL.TRAIN_FRACTION} * count(*) OVER (PARTITION BY IsArrDelayed))
                  THEN 'train' ELSE 'test' END AS split FROM m),
tr AS (SELECT * EXCLUDE (split) FROM sp WHERE split = 'train'),
te AS (SELECT * FROM sp WHERE split = 'test'),
ma AS ({_MODEL_SELECT.format(src='features')}),
pool AS (SELECT * FROM ma p WHERE IsArrDelayed = 1 AND NOT EXISTS (
           SELECT 1 FROM te WHERE te.FlightKey = p.FlightKey AND te.FlightDate = p.FlightDate
                              AND te.CRSDepTime = p.CRSDepTime AND te.TaxiOut = p.TaxiOut)),
x AS (SELECT greatest(0, count_if(IsArrDelayed = 0) - count_if(IsArrDelayed = 1)) AS extra FROM tr),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_hash_order(PL.EXTRA_SEED)}) AS rn2 FROM pool)
       WHERE rn2 <= (SELECT extra FROM x)),
bt AS (SELECT *, 'base' AS source FROM tr UNION ALL SELECT * EXCLUDE (rn2), 'extra' AS source FROM ex)
"""


def pq(body: str) -> str:
    """Pipeline CTEs + body."""
    return q(_PIPE + body)


# ---------------------------------------------------------------------------
# M1, M2, M6 samplers
# ---------------------------------------------------------------------------
@register("sample_per_group", q(f"""
SELECT Year, FlightKey, FlightDate, CRSDepTime, TaxiOut, Airline, ArrDelayMinutes FROM (
  SELECT *, row_number() OVER (PARTITION BY Year ORDER BY {_hash_order(PL.SEED)}) AS rn FROM features)
WHERE rn <= {PL.SAMPLE_PER_YEAR}"""))
def sample_per_group(spark, sf_dir):
    return PL.sampled_flights(spark, sf_dir).select("Year", *KEY_COLS, "Airline", "ArrDelayMinutes")


@register("sample_delayed", q(f"""
SELECT {KEY_SQL}, ArrDelayMinutes FROM (
  SELECT *, row_number() OVER (ORDER BY {_hash_order(PL.SEED)}) AS rn FROM features WHERE ArrDelayMinutes > 15)
WHERE rn <= {DELAYED_SAMPLE}"""))
def sample_delayed(spark, sf_dir):
    f = flights(spark, sf_dir)
    return sampling.sample_rows(f, DELAYED_SAMPLE, "FlightKey", KEY_COLS, seed=PL.SEED,
                                where=F.col("ArrDelayMinutes") > 15).select(*KEY_COLS, "ArrDelayMinutes")


@register("sample_scatter", q(f"""
SELECT {KEY_SQL}, Distance, ArrDelayMinutes FROM (
  SELECT *, row_number() OVER (ORDER BY {_hash_order(PL.SEED)}) AS rn FROM features
  WHERE Distance IS NOT NULL AND ArrDelayMinutes IS NOT NULL)
WHERE rn <= {SCATTER_SAMPLE}"""))
def sample_scatter(spark, sf_dir):
    f = flights(spark, sf_dir).dropna(subset=["Distance", "ArrDelayMinutes"])
    return sampling.sample_rows(f, SCATTER_SAMPLE, "FlightKey", KEY_COLS, seed=PL.SEED) \
                   .select(*KEY_COLS, "Distance", "ArrDelayMinutes")


# ---------------------------------------------------------------------------
# L1 model table, M3 split, A31 class balance, M5 balancing
# ---------------------------------------------------------------------------
@register("model_dataset", q(_MODEL_SELECT.format(src="features")))
def model_dataset(spark, sf_dir):
    return prep.model_dataset(features(spark, sf_dir))


@register("split_stratified", pq(f"SELECT {KEY_SQL}, IsArrDelayed, split FROM sp"))
def split_stratified(spark, sf_dir):
    return PL.split(spark, sf_dir).select(*KEY_COLS, TARGET, "split")


@register("balance_classes", pq(f"SELECT {KEY_SQL}, IsArrDelayed, source FROM bt"))
def balance_classes(spark, sf_dir):
    return PL.balanced_train(spark, sf_dir).select(*KEY_COLS, TARGET, "source")


@register("class_balance", pq(f"""
, lab AS (SELECT split AS dataset, IsArrDelayed FROM sp UNION ALL SELECT 'balanced_train', IsArrDelayed FROM bt),
c AS (SELECT dataset, IsArrDelayed, count(*) AS rows FROM lab GROUP BY dataset, IsArrDelayed)
SELECT dataset, IsArrDelayed, rows, {r6('rows / sum(rows) OVER (PARTITION BY dataset)', 'share')},
       {r6('sum(CASE WHEN IsArrDelayed = 0 THEN rows END) OVER (PARTITION BY dataset) / '
           'sum(CASE WHEN IsArrDelayed = 1 THEN rows END) OVER (PARTITION BY dataset)', 'neg_per_pos')}
FROM c"""))
def class_balance(spark, sf_dir):
    s = PL.split(spark, sf_dir).select(F.col("split").alias("dataset"), TARGET)
    b = PL.balanced_train(spark, sf_dir).select(F.lit("balanced_train").alias("dataset"), TARGET)
    return sampling.class_balance(s.unionByName(b), TARGET, by=["dataset"])


# ---------------------------------------------------------------------------
# L4/L5 impute + scale, L6 label encoding (fit on the balanced train set)
# ---------------------------------------------------------------------------
CATEGORICAL = ["DepTimeBlk", "Airline", "Origin", "Dest", "DepTimeOfDay", "DayOfWeekName", "MonthName"]
NUMERIC = [c for c in MODEL_FEATURES if c not in CATEGORICAL]


def _impute_sql() -> str:
    parts = []
    for c in NUMERIC:
        med = f"(SELECT quantile_cont({c}, 0.5) FROM bt)"
        x = f"coalesce(CAST({c} AS DOUBLE), {med})"
        parts.append(f"SELECT '{c}' AS feature, {r6(med, 'median')}, {r6(f'avg({x})', 'mean')}, "
                      f"{r6(f'CASE WHEN stddev_pop({x}) = 0 OR stddev_pop({x}) IS NULL THEN 1 ELSE stddev_pop({x}) END', 'std')} FROM bt")
    return " UNION ALL ".join(parts)


@register("impute_scale", pq(_impute_sql()))
def impute_scale(spark, sf_dir):
    return prep.fit_impute_scale(PL.balanced_train(spark, sf_dir), NUMERIC)


def _encode_sql() -> str:
    vals = " UNION ".join(f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS value FROM bt"
                          for c in CATEGORICAL)
    return (f", v AS ({vals}) SELECT feature, value, "
            f"CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INT) AS code FROM v")


@register("label_encode", pq(_encode_sql()))
def label_encode(spark, sf_dir):
    return prep.fit_label_encoders(PL.balanced_train(spark, sf_dir), CATEGORICAL)


# ---------------------------------------------------------------------------
# L5/L7/F29 and X6 on whole rows: the test split through the preprocessing and back
# ---------------------------------------------------------------------------
_MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC)
_FILLED = ", ".join(f"coalesce(CAST(bt.{c} AS DOUBLE), md.{c}) AS {c}" for c in NUMERIC)
_PREP_SQL = f""", md AS (SELECT {_MEDIANS} FROM bt), fl AS (SELECT {_FILLED} FROM bt, md),
mu AS (SELECT {', '.join(f"avg({c}) AS {c}" for c in NUMERIC)} FROM fl),
sd AS (SELECT {', '.join(f"CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}" for c in NUMERIC)} FROM fl),
cl AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM (
       {" UNION ".join(f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS value FROM bt" for c in CATEGORICAL)}))
"""


def _class_joins() -> str:
    return " ".join(f"LEFT JOIN cl AS c_{c} ON c_{c}.feature = '{c}' AND c_{c}.value = coalesce(CAST(te.{c} AS VARCHAR), 'Unknown')"
                    for c in CATEGORICAL)


def _fitted(spark, sf_dir):
    bt = PL.balanced_train(spark, sf_dir)
    return prep.fit_impute_scale(bt, NUMERIC), prep.fit_label_encoders(bt, CATEGORICAL).checkpoint()


_KEYS = ", ".join(f"te.{k} AS key_{k}" for k in KEY_COLS)


@register("encode_rows", pq(_PREP_SQL + f"""
SELECT {_KEYS}, {', '.join(r6(f'(coalesce(CAST(te.{c} AS DOUBLE), md.{c}) - mu.{c}) / sd.{c}', f'x_{c}') for c in NUMERIC)},
       {', '.join(f'CAST(coalesce(c_{c}.code, 0) AS INT) AS x_{c}' for c in CATEGORICAL)}
FROM te CROSS JOIN md CROSS JOIN mu CROSS JOIN sd {_class_joins()}"""))
def encode_rows(spark, sf_dir):
    """Every row of the test split, imputed, scaled and encoded by what the train set taught."""
    params, classes = _fitted(spark, sf_dir)
    return _prefixed(spark, sf_dir, lambda df: prep.apply_impute_scale(
        prep.apply_label_encoders(df, classes, CATEGORICAL), params, NUMERIC))


@register("decode_rows", pq(_PREP_SQL + f"""
SELECT {_KEYS}, {', '.join(r6(f'coalesce(CAST(te.{c} AS DOUBLE), md.{c})', f'x_{c}') for c in NUMERIC)},
       {', '.join(f"coalesce(c_{c}.value, (SELECT value FROM cl WHERE feature = '{c}' AND code = 0)) AS x_{c}" for c in CATEGORICAL)}
FROM te CROSS JOIN md {_class_joins()}"""))
def decode_rows(spark, sf_dir):
    """The encoded rows of the test split back in raw values."""
    params, classes = _fitted(spark, sf_dir)
    return _prefixed(spark, sf_dir, lambda df: prep.decode_rows(prep.apply_impute_scale(
        prep.apply_label_encoders(df, classes, CATEGORICAL), params, NUMERIC), params, classes, NUMERIC, CATEGORICAL))


def _prefixed(spark, sf_dir, change):
    """The test split with ``key_`` columns as they are and its features, changed, as ``x_`` columns."""
    rows = PL.test_split(spark, sf_dir)
    rows = rows.select(*[F.col(k).alias(f"key_{k}") for k in KEY_COLS], *MODEL_FEATURES)
    return change(rows).select(*[f"key_{k}" for k in KEY_COLS], *[F.col(c).alias(f"x_{c}") for c in MODEL_FEATURES])


# ---------------------------------------------------------------------------
# Score requests and their route distance
# ---------------------------------------------------------------------------
def requests(spark, sf_dir):
    """Request table derived from the flights: the N_REQUESTS rows with the
    smallest hash; every second request leaves its distance empty."""
    f = flights(spark, sf_dir)
    r = sampling.sample_rows(f, N_REQUESTS, "FlightKey", KEY_COLS, seed=PL.SEED)
    r = r.withColumn("__hx", sampling.hash_hex("FlightKey", PL.SEED))
    from pyspark.sql import Window
    # rank among the N_REQUESTS selected rows only
    w = Window.orderBy("__hx", *KEY_COLS)
    return r.select(F.row_number().over(w).cast("long").alias("request_id"), "FlightDate", "Airline",
                    "Origin", "Dest",
                    F.format_string("%02d:%02d", F.floor(F.col("CRSDepTime") / 100).cast("int"),
                                    (F.col("CRSDepTime") % 100).cast("int")).alias("DepTime"),
                    "Distance", "__hx") \
            .withColumn("Distance", F.when(F.col("request_id") % 2 == 0, F.col("Distance").cast("double"))) \
            .drop("__hx")


@register("route_distance_lookup", q(f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {_hash_order(PL.SEED)}) AS request_id FROM flights),
rq AS (SELECT request_id, Origin, Dest, CASE WHEN request_id % 2 = 0 THEN CAST(Distance AS DOUBLE) END AS Distance
       FROM r WHERE request_id <= {N_REQUESTS}),
med AS (SELECT Origin, Dest, quantile_cont(Distance, 0.5) AS route_distance FROM flights
        WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest)
SELECT rq.Origin, rq.Dest, request_id, {r6('coalesce(rq.Distance, med.route_distance, 1000.0)', 'Distance')}
FROM rq LEFT JOIN med ON rq.Origin = med.Origin AND rq.Dest = med.Dest""".replace("\n, r AS", ", r AS", 1)))
def route_distance_lookup(spark, sf_dir):
    req = requests(spark, sf_dir).select("request_id", "Origin", "Dest", "Distance")
    return routes.fill_distance(req, PL.route_counts(spark, sf_dir))


@register("route_distance_flights", q(f"""
, med AS (SELECT Origin, Dest, quantile_cont(Distance, 0.5) AS route_distance FROM flights
          WHERE Origin IS NOT NULL AND Dest IS NOT NULL GROUP BY Origin, Dest),
rq AS (SELECT Origin, Dest, CASE WHEN FlightNumber % 2 = 0 THEN CAST(Distance AS DOUBLE) END AS Distance FROM flights)
SELECT Origin, Dest, count(*) AS requests, CAST(count_if(Distance IS NULL) AS BIGINT) AS filled,
       {r6('avg(coalesce(Distance, route_distance, 1000.0))', 'avg_distance')}
FROM rq LEFT JOIN med USING (Origin, Dest) GROUP BY ALL""".replace("\n, med AS", ", med AS", 1)))
def route_distance_flights(spark, sf_dir):
    """J5/A27 with every flight as a request; half of them leave their distance empty."""
    f = flights(spark, sf_dir)
    req = f.select("Origin", "Dest", F.when(F.col("FlightNumber") % 2 == 0, F.col("Distance").cast("double")).alias("Distance"),
                   (F.col("FlightNumber") % 2 != 0).alias("empty"))
    out = routes.fill_distance(req, PL.route_counts(spark, sf_dir))
    return out.groupBy("Origin", "Dest").agg(F.count(F.lit(1)).alias("requests"), F.count_if("empty").alias("filled"),
                                             F.avg("Distance").alias("avg_distance"))
