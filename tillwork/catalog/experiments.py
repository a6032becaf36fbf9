from pyspark.sql import functions as F

from tillwork.catalog import query
from tillwork.catalog.sqltext import r
from tillwork.functions.numbers import rounded
from tillwork.operators.reports import experiments as x
from tillwork.operators.reports import histories as h

_LOG = """log AS (SELECT event_id AS experiment_id, ['retrieval', 'ranking', 'hybrid'][user_id % 3 + 1] AS model_type, ts AS completed_at,
  CASE WHEN user_id % 3 <> 1 THEN value / 500e0 END AS recall, CASE WHEN user_id % 3 <> 0 THEN value / 400e0 END AS rmse,
  CAST(user_id % 5 AS VARCHAR) AS learning_rate, CAST(user_id % 4 AS VARCHAR) AS batch_size, event_type AS optimizer,
  user_id % 7 AS dataset, user_id % 20 AS feature_config, user_id % 12 AS model_config, user_id, value FROM events)"""


def _log(t):
    u = F.col("user_id")
    kind = F.element_at(F.array(F.lit("retrieval"), F.lit("ranking"), F.lit("hybrid")), (F.pmod(u, F.lit(3)) + 1).cast("int"))
    return t.events.select(
        F.col("event_id").alias("experiment_id"), kind.alias("model_type"), F.col("ts").alias("completed_at"),
        F.when(F.pmod(u, F.lit(3)) != 1, F.col("value") / F.lit(500.0)).alias("recall"),
        F.when(F.pmod(u, F.lit(3)) != 0, F.col("value") / F.lit(400.0)).alias("rmse"),
        F.pmod(u, F.lit(5)).cast("string").alias("learning_rate"), F.pmod(u, F.lit(4)).cast("string").alias("batch_size"),
        F.col("event_type").alias("optimizer"), F.pmod(u, F.lit(7)).alias("dataset"),
        F.pmod(u, F.lit(20)).alias("feature_config"), F.pmod(u, F.lit(12)).alias("model_config"), u, "value")


_BEST = {"recall": "max", "rmse": "min"}


def _avg(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28,10))) AS DOUBLE) / count({c})"


@query("best_per_group", f"""WITH {_LOG} SELECT model_type, count(*) AS n, {r('max(recall)', 4)} AS best_recall,
  {r('min(rmse)', 4)} AS best_rmse FROM log GROUP BY 1""")
def best_per_group(t):
    return x.best_per_group(_log(t), "model_type", _BEST)


@query("top_configurations", f"""WITH {_LOG} SELECT model_type, rank_no, experiment_id, recall, rmse FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY model_type ORDER BY CASE WHEN model_type = 'ranking' THEN -rmse ELSE recall END DESC,
    experiment_id) AS rank_no FROM log) WHERE rank_no <= 10""")
def top_configurations(t):
    main = F.when(F.col("model_type") == "ranking", -F.col("rmse")).otherwise(F.col("recall"))
    return x.top_configurations(_log(t), main, ["experiment_id", "recall", "rmse"])


@query("metrics_trend", f"""WITH {_LOG} SELECT experiment_id, model_type, max(recall) OVER w AS best_recall, min(rmse) OVER w AS best_rmse,
  count(*) OVER w AS run_no FROM log WINDOW w AS (PARTITION BY model_type ORDER BY completed_at, experiment_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def metrics_trend(t):
    return x.metrics_trend(_log(t), _BEST).select("experiment_id", "model_type", "best_recall", "best_rmse", "run_no")


@query("dataset_comparison", f"""WITH {_LOG} SELECT dataset, model_type, count(*) AS n, {r('max(recall)', 4)} AS best_recall,
  {r(_avg('recall'), 4)} AS avg_recall, {r('min(rmse)', 4)} AS best_rmse, {r(_avg('rmse'), 4)} AS avg_rmse FROM log GROUP BY 1, 2""")
def dataset_comparison(t):
    return x.dataset_comparison(_log(t), "dataset", _BEST)


# Histories: 3 .. 42 epochs with falling losses.
_EPOCHS = f"""ep AS (SELECT experiment_id, model_type, recall, 3 + user_id % 40 AS n_epochs, unnest(range(3 + user_id % 40)) AS at_, value FROM log),
flat AS (SELECT experiment_id, model_type, recall, n_epochs, at_, {r('value / (at_ + 1)', 4)} AS train,
  {r('value / (at_ + 1) + 0.5e0', 4)} AS val, {r('value / 100e0', 4)} AS query_mean FROM ep)"""


def _histories(t):
    n = (F.pmod("user_id", F.lit(40)) + 3).cast("int")
    epochs = F.sequence(F.lit(0), n - 1)

    def curve(fn):
        return F.transform(epochs, fn)

    value = F.col("value")
    history = F.to_json(F.struct(
        epochs.alias("epochs"),
        F.struct(curve(lambda i: rounded(value / (i + 1), 4)).alias("loss"),
                 curve(lambda i: rounded(value / (i + 1) + F.lit(0.5), 4)).alias("val_loss")).alias("loss"),
        F.struct(F.struct(curve(lambda i: rounded(value / F.lit(100.0), 4)).alias("mean"),
                          curve(lambda i: F.array(i, i)).alias("histogram")).alias("query")).alias("weight_stats")))
    return _log(t).withColumn("history", history)


def _flat(t):
    return x.flatten_history(_histories(t), "experiment_id", "history")


@query("epoch_history_flatten", f"""WITH {_LOG}, {_EPOCHS} SELECT experiment_id, at_ AS epoch, train, val, query_mean FROM flat""")
def epoch_history_flatten(t):
    return _flat(t).select("experiment_id", "epoch", "train", "val", "query_mean")


@query("epoch_downsample", f"""WITH {_LOG}, {_EPOCHS} SELECT experiment_id, at_ AS epoch, train FROM flat
WHERE n_epochs <= 5 OR at_ % 5 = 0 OR at_ = n_epochs - 1""")
def epoch_downsample(t):
    return x.downsample_epochs(_flat(t)).select("experiment_id", "epoch", "train")


@query("training_heatmap", f"""WITH {_LOG}, {_EPOCHS}, best AS (SELECT experiment_id, ROW_NUMBER() OVER (ORDER BY recall DESC, experiment_id) AS rank_no
  FROM log WHERE recall IS NOT NULL), cells AS (SELECT f.experiment_id, rank_no, at_ AS epoch, {r('val', 2)} AS loss
  FROM flat f JOIN best b ON f.experiment_id = b.experiment_id WHERE rank_no <= 10 AND at_ % 10 = 0)
SELECT *, (SELECT min(loss) FROM cells) AS scale_min, (SELECT max(loss) FROM cells) AS scale_max FROM cells""")
def training_heatmap(t):
    return x.training_heatmap(_histories(t), "experiment_id", "history", F.col("recall"))


# Histories whose keys depend on the run; the SQL builds the same objects and does not list the keys either.
_OPEN = f"""opened AS (SELECT *, range(n) AS ep, list_transform(range(n), lambda i: {r('value / (i + 1)', 4)}) AS down, list_transform(range(n), lambda i: 0.25e0 * i) AS up
  FROM (SELECT *, 1 + user_id % 12 AS n FROM log)),
hist AS (SELECT experiment_id, learning_rate, optimizer, n, ep, json_object(
  'loss', json_object('loss', down, 'val_loss', up, 'aux_' || optimizer, down, 'steps', n),
  'gradient', json_object('total', up, optimizer, down), 'metrics', json_object('recall_at_' || (5 * (1 + user_id % 3)), up, 'short', up[1:1]),
  'weight_stats', json_object('query', json_object('mean', down, 'histogram', [ep, ep]), CASE WHEN model_type = 'ranking' THEN 'rating_head' ELSE 'candidate' END, json_object('std', up, 'skew', up),
    'other', json_object('mean', up)),
  'gradient_stats', json_object('candidate', json_object('norm', down, 'median', up)),
  'final_metrics', json_object('test_' || optimizer, n, 'note', model_type, 'none', NULL),
  'params', json_object('label_' || dataset, optimizer, 'learning_rate', 'other', 'deep', [n, n])) AS j FROM opened)"""


def _open_histories(t):
    n = (F.pmod("user_id", F.lit(12)) + 1).cast("int")
    epochs = F.sequence(F.lit(0), n - 1)
    down = F.transform(epochs, lambda i: rounded(F.col("value") / (i + 1), 4))
    up = F.transform(epochs, lambda i: F.lit(0.25) * i)
    opt = F.col("optimizer")

    def obj(*pairs):
        """An object of values of one type, with keys of the data."""
        return F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in pairs for x in pair])

    def both(*objects):
        """One object of several, as JSON text."""
        return F.concat(F.lit("{"), F.array_join(F.array(*[F.substring(o, F.lit(2), F.length(o) - 2) for o in objects]), ","), F.lit("}"))

    def field(name, text):
        return F.concat(F.lit('{"'), F.lit(name) if isinstance(name, str) else name, F.lit('":'), text, F.lit("}"))

    js = F.to_json
    second = F.when(F.col("model_type") == "ranking", "rating_head").otherwise("candidate")
    history = both(
        js(F.struct(epochs.alias("epochs"))),
        field("loss", both(js(obj(("loss", down), ("val_loss", up), (F.concat(F.lit("aux_"), opt), down))), js(F.struct(n.alias("steps"))))),
        field("gradient", js(obj(("total", up), (opt, down)))),
        field("metrics", js(obj((F.concat(F.lit("recall_at_"), 5 * (1 + F.pmod("user_id", F.lit(3)))), up), ("short", F.slice(up, 1, 1))))),
        field("weight_stats", both(
            field("query", both(js(obj(("mean", down))), js(F.struct(F.array(epochs, epochs).alias("histogram"))))),
            field(second, js(obj(("std", up), ("skew", up)))), field("other", js(obj(("mean", up)))))),
        field("gradient_stats", field("candidate", js(obj(("norm", down), ("median", up))))),
        field("final_metrics", both(js(obj((F.concat(F.lit("test_"), opt), n))), js(F.struct(F.col("model_type").alias("note"))), F.lit('{"none":null}'))),
        field("params", both(js(obj((F.concat(F.lit("label_"), F.col("dataset")), opt), ("learning_rate", F.lit("other")))), js(F.struct(F.array(n, n).alias("deep"))))))
    return _log(t).withColumn("history", history)


@query("epoch_history_curves", f"""WITH {_LOG}, {_OPEN},
entry AS (SELECT experiment_id, n, ep, s.key AS section, e.key AS name, e.value AS v FROM hist, json_each(j) s, json_each(s.value) e),
curve AS (
  SELECT experiment_id, n, ep, section, NULL AS tower, CASE WHEN section = 'loss' AND name = 'loss' THEN 'train'
    WHEN section = 'loss' AND name = 'val_loss' THEN 'val' ELSE name END AS name, v FROM entry WHERE section IN ('loss', 'gradient', 'metrics')
  UNION ALL
  SELECT experiment_id, n, ep, section, entry.name, s.key, s.value FROM entry, json_each(v) s
  WHERE section IN ('weight_stats', 'gradient_stats') AND entry.name IN ('query', 'candidate', 'rating_head')
    AND (s.key IN ('mean', 'std', 'min', 'max') OR section = 'gradient_stats' AND s.key = 'norm')),
point AS (SELECT *, unnest(CAST(v AS DOUBLE[])) AS value, generate_subscripts(CAST(v AS DOUBLE[]), 1) - 1 AS at_ FROM curve WHERE json_type(v) = 'ARRAY')
SELECT experiment_id, section, tower, name, ep[at_ + 1] AS epoch, value FROM point WHERE n <= 5 OR at_ % 5 = 0 OR at_ = n - 1""")
def epoch_history_curves(t):
    """Every curve of a history, whatever its name, at the sampled epochs."""
    curves = h.history_curves(_open_histories(t), "experiment_id", "history")
    return x.downsample_epochs(curves).select("experiment_id", "section", "tower", "name", "epoch", "value")


@query("history_values", f"""WITH {_LOG}, {_OPEN},
entry AS (SELECT experiment_id, learning_rate, optimizer, s.key AS section, e.key AS name, e.value AS v FROM hist, json_each(j) s, json_each(s.value) e
  WHERE s.key IN ('final_metrics', 'params'))
SELECT experiment_id, section, name, CASE json_type(v) WHEN 'NULL' THEN NULL ELSE v->>'$' END AS value FROM entry WHERE NOT (section = 'params' AND name IN ('learning_rate', 'optimizer'))
UNION ALL SELECT experiment_id, 'params', 'learning_rate', learning_rate FROM log UNION ALL SELECT experiment_id, 'params', 'optimizer', optimizer FROM log""")
def history_values(t):
    own = {"learning_rate": F.col("learning_rate"), "optimizer": F.col("optimizer")}
    return h.history_values(_open_histories(t), "experiment_id", "history", own)


@query("history_summary", f"WITH {_LOG} SELECT experiment_id, true AS available, CAST(1 + user_id % 12 AS INT) AS n_epochs, true AS histogram_available FROM log")
def history_summary(t):
    return h.history_summary(_open_histories(t), "experiment_id", "history")


def _score(rows: str, metric: str, lower: bool) -> str:
    sign, pick = ("<=", "ASC") if lower else (">=", "DESC")
    return f"""th AS (SELECT {metric} AS t FROM (SELECT {metric}, ROW_NUMBER() OVER (ORDER BY {metric} {pick}) AS rn,
    count(*) OVER () AS n FROM log WHERE {metric} IS NOT NULL) WHERE rn = greatest(1, CAST(floor(n * 30 / 100) AS BIGINT))),
g AS (SELECT param, value, count(*) AS n, count(*) FILTER (WHERE m {sign} (SELECT t FROM th)) AS n_good, {_avg('m')} AS a,
  {'min' if lower else 'max'}(m) AS b FROM {rows} WHERE value IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2),
scored AS (SELECT param, value, n, n_good, {r('((n_good + 1) / (n + 2)::DOUBLE) / greatest((n - n_good + 1) / (n + 2)::DOUBLE, 0.001e0)')} AS score,
  {r('a', 4)} AS avg_metric, {r('b', 4)} AS best_metric,
  CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM g)"""


def _long(metric: str) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS param, {p} AS value, {metric} AS m FROM log"
                              for p in ("learning_rate", "batch_size", "optimizer"))


@query("tpe_parameter_score", f"WITH {_LOG}, long AS ({_long('recall')}), {_score('long', 'recall', False)} SELECT * FROM scored")
def tpe_parameter_score(t):
    return x.score_parameters(_log(t), ["learning_rate", "batch_size", "optimizer"], "recall")


@query("tpe_parameter_score_ranking", f"WITH {_LOG}, long AS ({_long('rmse')}), {_score('long', 'rmse', True)} SELECT * FROM scored")
def tpe_parameter_score_ranking(t):
    return x.score_parameters(_log(t), ["learning_rate", "batch_size", "optimizer"], "rmse", lower_is_better=True)


_LISTS = """lists AS (SELECT *, list_filter([CASE WHEN user_id % 2 = 0 THEN 'customer_id 32D' END, CASE WHEN user_id % 3 = 0 THEN 'city 16D' END,
    concat('product_id ', user_id % 4 * 8, 'D')], lambda e: e IS NOT NULL) AS features,
  list_filter([CASE WHEN user_id % 5 = 0 THEN 'Rolling 60 days' END, CASE WHEN user_id % 7 = 0 THEN 'Top 80% products' END], lambda e: e IS NOT NULL) AS filters FROM log)"""


def _lists(t):
    u = F.col("user_id")

    def every(n):
        return F.pmod(u, F.lit(n)) == 0

    return _log(t).withColumn("features", F.array_compact(F.array(
        F.when(every(2), "customer_id 32D"), F.when(every(3), "city 16D"),
        F.concat(F.lit("product_id "), F.pmod(u, F.lit(4)) * 8, F.lit("D"))))).withColumn("filters", F.array_compact(F.array(
            F.when(every(5), "Rolling 60 days"), F.when(every(7), "Top 80% products"))))


@query("tpe_list_score", f"""WITH {_LOG}, {_LISTS}, long AS (SELECT 'features' AS param, unnest(features) AS value, recall AS m FROM lists),
{_score('long', 'recall', False)}
SELECT * EXCLUDE (p) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY param ORDER BY score DESC, value) AS p FROM scored) WHERE p <= 5""")
def tpe_list_score(t):
    return x.score_lists(_lists(t), ["features"], "recall", top=5)


@query("tpe_filter_score", f"""WITH {_LOG}, {_LISTS}, long AS (SELECT 'filters' AS param,
  unnest(CASE WHEN len(filters) > 0 THEN filters ELSE ['None'] END) AS value, recall AS m FROM lists), {_score('long', 'recall', False)}
SELECT * FROM scored""")
def tpe_filter_score(t):
    return x.score_lists(_lists(t), ["filters"], "recall", empty_as="None")


_MATRIX = """fc AS (SELECT DISTINCT feature_config, CASE WHEN feature_config % 2 = 0 THEN 'retrieval' ELSE 'ranking' END AS config_type FROM log),
mc AS (SELECT DISTINCT model_config, ['retrieval', 'ranking', 'multitask'][model_config % 3 + 1] AS model_type FROM log),
matrix AS (SELECT fc.feature_config, mc.model_config, count(log.experiment_id) AS n, max(log.recall) AS best_metric,
  mc.model_type = 'multitask' OR mc.model_type = fc.config_type AS is_compatible FROM fc CROSS JOIN mc
  LEFT JOIN log ON log.feature_config = fc.feature_config AND log.model_config = mc.model_config
  GROUP BY fc.feature_config, mc.model_config, mc.model_type, fc.config_type)"""


def _configs(t):
    log = _log(t)
    features = log.select("feature_config").distinct().withColumn(
        "config_type", F.when(F.pmod("feature_config", F.lit(2)) == 0, "retrieval").otherwise("ranking"))
    kinds = F.array(F.lit("retrieval"), F.lit("ranking"), F.lit("multitask"))
    models = log.select("model_config").distinct().withColumn(
        "model_type", F.element_at(kinds, (F.pmod("model_config", F.lit(3)) + 1).cast("int")))
    return log, features, models


@query("coverage_matrix", f"WITH {_LOG}, {_MATRIX} SELECT * FROM matrix")
def coverage_matrix(t):
    return x.coverage(*_configs(t), "recall")


@query("coverage_tested_pairs", f"WITH {_LOG}, {_MATRIX} SELECT feature_config, model_config, n, best_metric FROM matrix WHERE n > 0")
def coverage_tested_pairs(t):
    return x.tested_pairs(*_configs(t), "recall")


@query("coverage_untested_pairs", f"""WITH {_LOG}, {_MATRIX} SELECT feature_config, model_config FROM matrix WHERE n = 0 AND is_compatible
ORDER BY feature_config, model_config LIMIT 5""")
def coverage_untested_pairs(t):
    return x.untested_pairs(*_configs(t))
