"""Queries for how tables are kept and spread: snapshots by month, buckets, versions, slices of time, blocks, and the ranker's sums."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.config import settings
from tessera.functions.scan import running
from tessera.operators.asof import asof_join_sliced
from tessera.operators import metrics as mt
from tessera.operators.features import BINARY, CONTINUOUS
from tessera.operators.increments import quality_since, quality_tail, security_since, security_tail
from tessera.operators.labels import HORIZONS
from tessera.operators.quality import PRICES, QUALITY
from tessera.operators.sketches import ACCURACY, SMALLEST, sketch, unpivoted, windowed_psi
from tessera.plans import rank_trees as rt
from tessera.plans import stores
from tessera.queries import panel as pn
from tessera.queries import proxy as px
from tessera.queries.oracles import r6
from tessera.queries.panel import KEYS, query, r
from tessera.sources.snapshots import SnapshotTable
from tessera.sources.storage import Catalog
from tessera.staging import staged, staging_path

# Where the queries' increment begins, the first places that lambdas look at, and bin edges that no standard score falls on.
INCREMENT, TOP, EDGES = "2001-06-20", 10, [-1.7, -0.9, -0.4, 0.13, 0.45, 0.95, 1.8]


@query(f"SELECT ticker, date, CASE WHEN date >= (SELECT max(date) FROM prices WHERE date < DATE '{INCREMENT}') - INTERVAL 10 DAY THEN close * 2 ELSE close END AS close FROM prices")
def monthly_upsert(s, d):
    """Prices kept by month: those before the increment, then an upsert of all prices, doubled, of which the last ten days before it and later ones count."""
    table, own = SnapshotTable(s, staging_path(s)), px.prices(s, d).select("ticker", "date", "close")
    table.overwrite(own.where(F.col("date") < INCREMENT))
    table.upsert(own.withColumn("close", F.col("close") * 2))
    return table.read()


@query(f"SELECT f.date, f.ticker, l.horizon, {r6('f.rsi_14', 'rsi_14')}, {r6('l.forward_return', 'forward_return')}, l.membership_reliability FROM scored_features f JOIN labels3 l ON l.date = f.date AND l.ticker = f.ticker")
def bucketed_model_frame(s, d):
    """The model frame from stored features and labels in buckets of the same keys: the join shuffles neither."""
    cat = Catalog(s, settings(staging_path(s), **{"storage.buckets": 16}))
    cat.write(pn.store(s, d), "processed", "feature_store", ("ticker", "date"))
    cat.write(pn.labels(s, d).drop("sector", "industry"), "processed", "label_store", ("ticker", "date"))
    frame = stores.model_frame(cat.read("processed", "feature_store"), cat.read("processed", "label_store"))
    return frame.select(*KEYS, "horizon", r("rsi_14"), r("forward_return"), "membership_reliability")


@query("SELECT step, ran, n_rows FROM (VALUES ('first', true), ('same', false), ('settings', true), ('input', true), ('same again', false)) v(step, ran), (SELECT count(*) AS n_rows FROM prices)")
def stage_versions(s, d):
    """Whether a stage runs: at first, with nothing changed, with another setting, with another input, and with nothing changed again."""
    cat, rows = Catalog(s, settings(staging_path(s))), []
    cat.write(px.prices(s, d).select(*KEYS, *PRICES), "raw", "prices")
    build = lambda: cat.write(cat.read("raw", "prices").select(*KEYS, "close"), "processed", "closes")
    made = lambda days: cat.made("closes", [("raw", "prices")], [("processed", "closes")], {"days": days}, build)
    for step, days in (("first", 1), ("same", 1), ("settings", 2)):
        rows.append((step, made(days)))
    cat.write(px.prices(s, d).select(*KEYS, *PRICES, "volume"), "raw", "prices")
    rows += [("input", made(2)), ("same again", made(2))]
    n = cat.read("processed", "closes").agg(F.count("*").alias("n_rows"))
    return s.createDataFrame(rows, "step string, ran boolean").crossJoin(n)  # five rows and one


@query(
    f"SELECT p.date, p.ticker, e.earnings_date AS last_event, e.event_ticker, {r6('e.surprise_pct', 'surprise_pct')} FROM prices p ASOF LEFT JOIN "
    "(SELECT earnings_date, max(ticker) AS event_ticker, arg_max(surprise_pct, ticker) AS surprise_pct FROM earn GROUP BY earnings_date) e ON p.date >= e.earnings_date"
)
def asof_market_event(s, d):
    """For each price the market's last event, whoever's: one key has all rows, dealt out by slices of time."""
    left = px.prices(s, d).select(*KEYS).withColumn("market", F.lit("all"))
    events = px.earnings(s, d).withColumn("market", F.lit("all"))
    take = {"last_event": F.col("earnings_date"), "event_ticker": F.col("ticker"), "surprise_pct": F.col("surprise_pct")}
    return asof_join_sliced(left, events, "market", "date", "earnings_date", take, tie=F.col("ticker")).select(*KEYS, "last_event", "event_ticker", r("surprise_pct"))


_SO_FAR = "OVER (ORDER BY date, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT date, ticker, {r6(f'sum(volume) {_SO_FAR}', 'volume_so_far')}, {r6(f'max(high) {_SO_FAR}', 'highest')}, {r6(f'min(low) {_SO_FAR}', 'lowest')}, count(*) {_SO_FAR} AS rows_so_far FROM prices")
def market_so_far(s, d):
    """Running sum, extremes and count over all prices in order of date and ticker, block by block."""
    values = {"volume_so_far": ("sum", F.col("volume")), "highest": ("max", F.col("high")), "lowest": ("min", F.col("low")), "rows_so_far": ("count", F.lit(1))}
    out = running(px.prices(s, d).select(*KEYS, "volume", "high", "low"), [], "date", values, ("ticker",))
    return out.select(*KEYS, r("volume_so_far"), r("highest"), r("lowest"), "rows_so_far")


_GRADED = "SELECT date, horizon, ticker, score, least(greatest(round(100 * coalesce(target_rank, 0)), 0), 100)::int AS grade FROM preds"
_PLACED = f"SELECT *, pow(2, grade / 100::double) - 1 AS worth, row_number() OVER (PARTITION BY date, horizon ORDER BY score DESC, ticker) AS place, row_number() OVER (PARTITION BY date, horizon ORDER BY grade DESC, ticker) AS best FROM ({_GRADED})"
_DISCOUNTED = (
    f"SELECT *, CASE WHEN place <= {TOP} THEN 1 / log2(place + 1) ELSE 0 END AS discount, sum(CASE WHEN best <= {TOP} THEN worth / log2(best + 1) END) OVER (PARTITION BY date, horizon) AS ideal FROM ({_PLACED})"
)
_CHANGE = "abs(a.worth - b.worth) * abs(a.discount - b.discount) / nullif(a.ideal, 0)"
_DOUBT = "1 / (1 + exp(sign(a.worth - b.worth) * (a.score - b.score)))"


@query(
    f"SELECT * FROM (WITH q AS MATERIALIZED ({_DISCOUNTED}) SELECT a.date, a.horizon, a.ticker, {r6(f'coalesce(sum(sign(a.worth - b.worth) * {_CHANGE} * {_DOUBT}), 0)', 'g')}, {r6(f'coalesce(sum({_CHANGE} * {_DOUBT} * (1 - {_DOUBT})), 0)', 'h')} "
    f"FROM q a LEFT JOIN q b ON b.date = a.date AND b.horizon = a.horizon AND b.grade <> a.grade AND least(a.place, b.place) <= {TOP} GROUP BY ALL)"
)
def lambda_gradients(s, d):
    """What each prediction is pulled by in its date's order, and the second derivative: pairs with the first ten, weighted by what their swap changes the NDCG."""
    rows = pn.predictions(s, d).select("date", "horizon", "ticker", "score", rt.relevance("target_rank").alias("grade")).withColumn("id", F.monotonically_increasing_id())
    by = ["date", "horizon"]
    return rt.lambdas(rt.with_ideal(staged(rows), by, TOP), by, TOP).select(*by, "ticker", r("g"), r("h"))


_BIN = " + ".join(f"(v > {e})::int" for e in EDGES)
_LONG = f"SELECT date, ticker, feature, v FROM (UNPIVOT (SELECT date, ticker, {', '.join(CONTINUOUS)} FROM scored_features) ON {', '.join(CONTINUOUS)} INTO NAME feature VALUE v)"
_SUMS = f"SELECT l.horizon, x.feature, 1 + {_BIN} AS cut, sum(l.target_rank - 0.5) AS g, count(*) AS n FROM ({_LONG}) x JOIN labels3 l USING (date, ticker) WHERE l.target_rank IS NOT NULL GROUP BY ALL"
_UP = f"SELECT *, sum(g) OVER u AS up_g, sum(n) OVER u AS up_n, sum(g) OVER w AS all_g, sum(n) OVER w AS all_n FROM ({_SUMS}) WINDOW w AS (PARTITION BY horizon, feature), u AS (PARTITION BY horizon, feature ORDER BY cut)"
_GAIN = "up_g * up_g / up_n + (all_g - up_g) * (all_g - up_g) / (all_n - up_n) - all_g * all_g / all_n"


@query(
    f"SELECT horizon, feature, cut, {r6('gain', digits=4)}, up_n::bigint AS left_rows, (all_n - up_n)::bigint AS right_rows FROM (SELECT *, {_GAIN} AS gain FROM ({_UP}) WHERE up_n >= 50 AND all_n - up_n >= 50) QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY gain DESC, feature) = 1"
)
def histogram_splits(s, d):
    """The split of all features of the model frame that tells high ranks from low ones best, for each horizon: sums by (node, feature, bin), a node a horizon."""
    frame = stores.model_frame(pn.store(s, d), pn.labels(s, d).drop("sector", "industry")).where("target_rank is not null")
    names, days = list(HORIZONS), list(HORIZONS.values())
    rows = rt.with_bins(frame, ["horizon_days", *CONTINUOUS], [days[:-1], *([EDGES] * len(CONTINUOUS))], ["target_rank"])
    rows = staged(rows.select("x", (F.col("target_rank") - 0.5).alias("g"), F.lit(1.0).alias("h")))
    tree, node, leaves = rt.Tree(), 0, []
    for k in range(1, len(days)):  # horizons one by one go left
        tree.split(node, 0, k, False, 0.0, (0.0, 0.0))
        leaves.append(tree.left[node])
        node = tree.right[node]
    leaves.append(node)
    bins = max(len(EDGES), len(days)) + 2
    sums = rt.histograms(rows, tree, leaves, list(range(1, 1 + len(CONTINUOUS))), 1 + len(CONTINUOUS), bins)
    best = rt.best_splits(sums, 50)
    horizon, feature = (F.array(*map(F.lit, x)) for x in (names, CONTINUOUS))
    at = F.array_position(F.array(*map(F.lit, leaves)), F.col("node")).cast("int")
    return best.select(F.element_at(horizon, at).alias("horizon"), F.element_at(feature, F.col("feature")).alias("feature"), F.col("bin").alias("cut"), r("gain", digits=4), F.col("left_n").alias("left_rows"), F.col("right_n").alias("right_rows"))


EVERY = CONTINUOUS + BINARY
SECURITY = CONTINUOUS[: CONTINUOUS.index("sector_rel_ret_1d")] + ["beta_63d"]


@query(f"SELECT date, ticker, {', '.join(r6(c) for c in SECURITY)} FROM security2 WHERE date >= DATE '{INCREMENT}'")
def incremental_features(s, d):
    """Features of the increment's days from the tails of those before it: no window runs over older rows than these."""
    rows = pn.panel(s, d).select(*KEYS, *PRICES, "volume", *(f"spx_ret_{k}d" for k in (1, 5, 21, 63)))
    tail = staged(security_tail(rows.where(F.col("date") < INCREMENT)))
    return security_since(tail, rows.where(F.col("date") >= INCREMENT)).select(*KEYS, *(r(c) for c in SECURITY))


FILLED = [*PRICES, "volume"]


@query(
    f"SELECT c.date, c.ticker, {', '.join(r6(f'c.{c}', c) for c in FILLED)}, {', '.join(f'q.{c}' for c in QUALITY)} FROM cleaned c JOIN flags q ON q.date = c.date AND q.ticker = c.ticker WHERE c.date >= DATE '{INCREMENT}'"
)
def incremental_quality(s, d):
    """Filled prices and quality of the increment's days, from the counters and last rows of those before it."""
    rows = pn.grid(s, d).select(*KEYS, *FILLED, "was_observed")
    tail = staged(quality_tail(rows.where(F.col("date") < INCREMENT)))
    return quality_since(tail, rows.where(F.col("date") >= INCREMENT)).select(*KEYS, *(r(c) for c in FILLED), *QUALITY)


_MELTED = f"SELECT date, feature, x FROM (UNPIVOT (SELECT date, {', '.join(r6(c) for c in EVERY)} FROM ratios) ON {', '.join(EVERY)} INTO NAME feature VALUE x)"


def melted(s, d):
    return unpivoted(pn.raw(s, d).select("date", *(r(c) for c in EVERY)), EVERY, ["date"])


# Each year against the one before.
YEARS = [(str(y), date(y - 1, 1, 1), date(y - 1, 12, 31), date(y, 1, 1), date(y, 12, 31)) for y in range(1993, 2002)]
_WINDOWS = "(VALUES " + ", ".join("('%s', DATE '%s', DATE '%s', DATE '%s', DATE '%s')" % w for w in YEARS) + ") w(win, a, b, c, d)"
_BUCKET = f"CASE WHEN abs(x) <= {SMALLEST}::double THEN 0 ELSE sign(x) * ceil(ln(abs(x) / {SMALLEST}::double) / ln((1 + {ACCURACY}::double) / (1 - {ACCURACY}::double))) END::int"
_COUNTS = (
    f"SELECT win, feature, bucket, count(CASE WHEN date BETWEEN a AND b THEN 1 END) AS a, count(CASE WHEN date BETWEEN c AND d THEN 1 END) AS b, coalesce(sum(CASE WHEN date BETWEEN a AND b THEN x END), 0) AS ta, coalesce(sum(CASE WHEN date BETWEEN c AND d THEN x END), 0) AS tb "
    f"FROM (SELECT *, {_BUCKET} AS bucket FROM ({_MELTED})), {_WINDOWS} WHERE date BETWEEN a AND b OR date BETWEEN c AND d GROUP BY ALL"
)
_EDGED = (
    "SELECT p.*, e.edges FROM p LEFT JOIN (SELECT win, feature, list_sort(list_distinct(quantile_disc_rank)) AS edges FROM (SELECT win, feature, list(edge) AS quantile_disc_rank FROM "
    "(SELECT win, feature, k, min(bucket) AS edge FROM (SELECT *, sum(a) OVER (PARTITION BY win, feature ORDER BY bucket) AS upto, sum(a) OVER (PARTITION BY win, feature) AS n FROM p), range(11) g(k) "
    "WHERE upto > floor(k::double / 10 * (n - 1)) AND n > 0 GROUP BY ALL) GROUP BY ALL)) e USING (win, feature)"
)
_BINNED = f"SELECT win, feature, CASE WHEN bucket BETWEEN edges[1] AND edges[-1] THEN greatest(1, len(list_filter(edges, lambda v: v < bucket))) END AS bin, sum(a)::double AS a, sum(b)::double AS b, max(len(edges)) AS e FROM ({_EDGED}) GROUP BY ALL"
_SHARES = "SELECT win, feature, greatest(coalesce(a / nullif(sum(a) OVER f, 0), 0), 1e-6) AS a, greatest(coalesce(b / nullif(sum(b) OVER f, 0), 0), 1e-6) AS b FROM q WHERE bin IS NOT NULL WINDOW f AS (PARTITION BY win, feature)"


@query(
    f"SELECT * FROM (WITH p AS MATERIALIZED ({_COUNTS}), q AS MATERIALIZED ({_BINNED}), n AS (SELECT win, feature, sum(a)::bigint AS a, sum(b)::bigint AS b, sum(ta) AS ta, sum(tb) AS tb FROM p GROUP BY ALL) "
    f"SELECT n.win AS period, n.feature, n.a AS reference_rows, n.b AS window_rows, {r6('n.ta / nullif(n.a, 0)', 'reference_mean')}, {r6('n.tb / nullif(n.b, 0)', 'window_mean')}, {r6('CASE WHEN n.a > 0 AND n.b > 0 THEN CASE WHEN q2.e <= 2 THEN 0 ELSE i.psi END END', 'psi', 4)} FROM n "
    f"JOIN (SELECT win, feature, max(e) AS e FROM q GROUP BY ALL) q2 USING (win, feature) LEFT JOIN (SELECT win, feature, sum((b - a) * ln(b / a)) AS psi FROM ({_SHARES}) GROUP BY ALL) i USING (win, feature))"
)
def psi_by_year(s, d):
    """Stability of all features, each year against the one before, from sketches of days that are written once."""
    days = staged(sketch(melted(s, d), ["date"]))
    out = windowed_psi(days, YEARS)
    return out.select(F.col("window").alias("period"), "feature", "reference_rows", "window_rows", r("reference_mean"), r("window_mean"), r("psi", digits=4))


@query(pn.drift_sql(_MELTED, 4))
def feature_drift_all(s, d):
    """Drift of all features with exact quantiles."""
    x, split = pn.raw(s, d).select("date", *(r(c) for c in EVERY)), F.col("date") <= F.lit(pn.TRAIN_END).cast("date")
    return mt.feature_drift(x.where(split), x.where(~split), EVERY).select("feature", r("train_mean"), r("val_mean"), r("mean_shift"), r("psi", digits=4))
