"""The queries over the driver's tables, by name, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, series, text, vectors
from ..operators import analytics, combine, encoders, lof, preprocess
from ..operators.kept import written
from ..operators.search import knn

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import catalog_models  # noqa: F401  (adds its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_models  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- neighbour search

#: Queries are the embeddings of all other classes, candidates those of the target class.
TARGET = 0


def embeddings(spark, d, first: int = 1, count: int = 64) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.slice(F.col("embedding").cast("array<double>"), first, count).alias("value"), "label"
    )


def _near(spark, d, k, metric, first=1, count=64) -> DataFrame:
    e = embeddings(spark, d, first, count)
    return knn(e.where(F.col("label") != TARGET), e.where(F.col("label") == TARGET), k, metric)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_ZIP = "list_transform(list_zip(q.{v}, c.{v}), lambda z: {f})"
_DISTANCES = {
    "euclidean": "sqrt(list_sum(" + _ZIP.format(v="{v}", f="(z[1] - z[2]) * (z[1] - z[2])") + "))",
    "manhattan": "list_sum(" + _ZIP.format(v="{v}", f="abs(z[1] - z[2])") + ")",
    "chebyshev": "list_max(" + _ZIP.format(v="{v}", f="abs(z[1] - z[2])") + ")",
    "cosine": "1 - list_cosine_similarity(q.{v}, c.{v})",
}


def _knn_cte(
    name: str, metric: str, k: int, v: str = "v", where: str = f"q.label <> {TARGET} AND c.label = {TARGET}", source: str = "e", by: str = "distance"
) -> str:
    pairs = f"SELECT q.vec_id AS query_id, c.vec_id AS train_id, {_DISTANCES[metric].format(v=v)} AS distance FROM {source} q JOIN {source} c ON {where}"
    ranked = f"SELECT query_id, train_id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY {by}, train_id))::INT AS rank FROM ({pairs})"
    return f"{name} AS (SELECT * FROM ({ranked}) WHERE rank <= {k})"


def _knn_sql(metric: str, k: int = 5, where: str | None = None) -> str:
    cte = _knn_cte("n", metric, k) if where is None else _knn_cte("n", metric, k, where=where)
    return f"WITH {_E}, {cte} SELECT query_id, train_id, rank, round(distance, 6) AS distance FROM n"


@_query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    return _rounded(_near(spark, d, 5, "euclidean"), "distance")


@_query(_knn_sql("manhattan"))
def knn_manhattan(spark, d):
    return _rounded(_near(spark, d, 5, "manhattan"), "distance")


@_query(_knn_sql("cosine"))
def knn_cosine(spark, d):
    return _rounded(_near(spark, d, 5, "cosine"), "distance")


@_query(_knn_sql("chebyshev"))
def knn_chebyshev(spark, d):
    return _rounded(_near(spark, d, 5, "chebyshev"), "distance")


@_query(_knn_sql("euclidean", 3, "c.label = (q.label + 1) % 10"))
def knn_per_class(spark, d):
    """Each embedding's nearest neighbours in the class after its own."""
    e = embeddings(spark, d)
    return _rounded(knn(e.withColumn("target", (F.col("label") + 1) % 10), e, 3, "euclidean", per_class=True), "distance")


@_query(_knn_sql("euclidean", 1, "q.label <> c.label"))
def nearest_unlike_neighbour(spark, d):
    """The nearest embedding of any other class: each query is dealt to the tiles of all classes but its own."""
    e = embeddings(spark, d)
    classes = e.agg(F.collect_set("label").alias("classes"))  # one row
    spread = e.crossJoin(F.broadcast(classes)).withColumn("target", F.explode(F.filter("classes", lambda c: c != F.col("label"))))
    return _rounded(knn(spread, e, 1, "euclidean", per_class=True), "distance")


def customers(spark, d) -> DataFrame:
    """Customers with features of their orders; the segment is the class."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("double")).alias("total")
    )
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_acctbal").cast("double") / 1000).alias("balance"), F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        (F.coalesce("total", F.lit(0.0)) / 1e5).alias("total")
    )


_CUST = """o AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice::DOUBLE) AS total FROM orders GROUP BY 1),
cu AS (SELECT c_custkey AS vec_id, c_mktsegment AS label, c_nationkey::DOUBLE AS nation, c_acctbal::DOUBLE / 1000 AS balance, coalesce(n_orders,
 0)::DOUBLE AS n_orders, coalesce(total, 0.0) / 1e5 AS total
 FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""
_SEGMENTS = "q.label = 'BUILDING' AND c.label = 'AUTOMOBILE'"


@_query(f"""WITH {_CUST}, e AS (SELECT vec_id, label, [balance, n_orders, total] AS v FROM cu), {_knn_cte("n", "euclidean", 5, where=_SEGMENTS)}
SELECT query_id, train_id, rank, round(distance, 6) AS distance FROM n""")
def early_fusion_knn(spark, d):
    """Two tabular branches joined and concatenated, then searched."""
    c = customers(spark, d)
    fused = combine.early_fusion(
        [c.select("sample_id", F.array("balance").alias("value")), c.select("sample_id", F.array("n_orders", "total").alias("value"))]
    )
    side = lambda s: fused.join(c.where(F.col("segment") == s).select("sample_id"), "sample_id")
    return _rounded(knn(side("BUILDING"), side("AUTOMOBILE"), 5, "euclidean"), "distance")


@_query(f"""WITH {_CUST}, e AS (SELECT vec_id, label, [nation, n_orders, floor(balance)] AS v FROM cu),
x AS (SELECT q.vec_id AS query_id, c.vec_id AS train_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] <> z[2])::INT)) / 3.0 AS distance
 FROM e q JOIN e c ON {_SEGMENTS}),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id))::INT AS rank FROM x) SELECT query_id, train_id, rank,
 round(distance, 6) AS distance FROM r WHERE rank <= 3""")
def knn_hamming(spark, d):
    c = customers(spark, d).select("sample_id", "segment", F.array("nation", "n_orders", F.floor("balance").cast("double")).alias("value"))
    return _rounded(knn(c.where("segment = 'BUILDING'"), c.where("segment = 'AUTOMOBILE'"), 3, "hamming"), "distance")


def _part_vectors(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("sample_id"),
        F.array((F.col("s_acctbal").cast("double") / 1000), F.col("s_nationkey").cast("double")).alias("value")
    )


@_query("""WITH s AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier),
x AS (SELECT q.id AS query_id, c.id AS train_id, abs(q.a - c.a) AS da, abs(q.b - c.b) AS db, q.a AS qa, q.b AS qb, c.a AS ca, c.b AS cb FROM s q
 JOIN s c ON q.id <> c.id),
m AS (SELECT query_id, train_id, 'sqeuclidean' AS metric, da * da + db * db AS distance FROM x
 UNION ALL SELECT query_id, train_id, 'canberra', CASE WHEN da = 0 THEN 0 ELSE da / (abs(qa) + abs(ca)) END + CASE WHEN db = 0 THEN 0 ELSE db
 / (abs(qb) + abs(cb)) END FROM x
 UNION ALL SELECT query_id, train_id, 'braycurtis', CASE WHEN abs(qa + ca) + abs(qb + cb) = 0 THEN 0 ELSE (da + db) / (abs(qa + ca) + abs(qb
 + cb)) END FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY distance, train_id) AS rank FROM m) SELECT metric, query_id, train_id,
 round(distance, 6) AS distance FROM r WHERE rank = 1""")
def knn_other_metrics(spark, d):
    v = _part_vectors(spark, d)
    out = [
        knn(v, v, 1, m, exclude_self=True).select(F.lit(m).alias("metric"), "query_id", "train_id", "distance")
        for m in ("sqeuclidean", "canberra", "braycurtis")
    ]
    return _rounded(out[0].union(out[1]).union(out[2]), "distance")


# ---------------------------------------------------------------- candidates

_MEDIAN_SQL = """WITH {e}, {n}, s AS (SELECT query_id, rank, v FROM n JOIN e ON vec_id = train_id), c AS (SELECT query_id, max(rank) AS k FROM s
 GROUP BY 1),
i AS (SELECT query_id, unnest(range(1, k + 1))::INT AS cand_rank, k FROM c), p AS (SELECT *, {prefix} AS n_used FROM i),
x AS (SELECT p.query_id, cand_rank, n_used, unnest(s.v) AS x, generate_subscripts(s.v, 1) AS dim FROM p JOIN s ON s.query_id = p.query_id
 AND s.rank <= n_used),
m AS (SELECT query_id, cand_rank, n_used, dim, median(x) AS m FROM x GROUP BY ALL)
SELECT m.query_id, cand_rank, n_used::INT AS n_used, n.train_id AS anchor_id, round(sum(m), 6) AS value_sum, round(max(m) FILTER (dim = 7), 6)
 AS value_7
FROM m JOIN n ON n.query_id = m.query_id AND n.rank = {anchor} GROUP BY ALL"""


def _digest(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.round(F.aggregate("value", F.lit(0.0), lambda a, b: a + b), 6).alias("value_sum"),
        F.round(F.get("value", F.lit(6)), 6).alias("value_7")
    )


def _medians(spark, d, step, anchor="rank"):
    near = _near(spark, d, 5, "euclidean")
    return _digest(combine.progressive_medians(near, embeddings(spark, d), step, anchor), "query_id", "cand_rank", "n_used", "anchor_id")


@_query(_MEDIAN_SQL.format(e=_E, n=_knn_cte("n", "euclidean", 5), prefix="least(2 * cand_rank - 1, k)", anchor="cand_rank"))
def progressive_median_odd(spark, d):
    return _medians(spark, d, "odd")


@_query(_MEDIAN_SQL.format(e=_E, n=_knn_cte("n", "euclidean", 5), prefix="cand_rank", anchor="cand_rank"))
def progressive_median_step(spark, d):
    return _medians(spark, d, "step")


@_query(_MEDIAN_SQL.format(e=_E, n=_knn_cte("n", "euclidean", 5), prefix="least(2 * cand_rank - 1, k)", anchor="n_used"))
def progressive_median_odd_anchor(spark, d):
    return _medians(spark, d, "odd", "odd")


def _halves(spark, d, k):
    return {"a": _near(spark, d, k, "euclidean", 1, 32), "b": _near(spark, d, k, "manhattan", 33, 32)}


_HALVES = "e AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@_query(f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 20, "a")}, {_knn_cte("nb", "manhattan", 20, "b")},
j AS (SELECT na.query_id, na.train_id, na.distance + nb.distance AS distance FROM na JOIN nb USING (query_id, train_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id))::INT AS rank FROM j)
SELECT query_id, train_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def consensus_retrieval(spark, d):
    """Neighbours that both halves of the embedding list, by the summed distances."""
    return _rounded(combine.consensus(_halves(spark, d, 20), 5), "distance")


_QUARTERS = "e AS (SELECT vec_id, label, " + ", ".join(
    f"list_transform(embedding[{1 + 16 * i}:{16 + 16 * i}], lambda x: x::DOUBLE) AS v{i}"
    for i in range(4)
) + " FROM embeddings)"


@_query(f"""WITH {_QUARTERS}, {", ".join(_knn_cte(f"n{i}", "cosine", 25, f"v{i}") for i in range(4))},
j AS (SELECT query_id, train_id, n0.distance + n1.distance + n2.distance + n3.distance AS distance FROM n0 JOIN n1 USING (query_id, train_id) JOIN n2
 USING (query_id, train_id) JOIN n3 USING (query_id, train_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id))::INT AS rank FROM j) SELECT query_id, train_id, rank,
 round(distance, 6) AS distance FROM r WHERE rank <= 3""")
def consensus_four_spaces(spark, d):
    return _rounded(combine.consensus({str(i): _near(spark, d, 25, "cosine", 1 + 16 * i, 16) for i in range(4)}, 3), "distance")


@_query(f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 4, "a")}, {_knn_cte("nb", "manhattan", 6, "b")},
i AS (SELECT DISTINCT query_id, rank AS cand_rank FROM na),
xa AS (SELECT i.query_id, cand_rank, unnest(e.a) AS x, generate_subscripts(e.a, 1) AS dim FROM i JOIN na ON na.query_id = i.query_id
 AND na.rank <= cand_rank JOIN e ON e.vec_id = na.train_id),
m AS (SELECT query_id, cand_rank, dim, median(x) AS m FROM xa GROUP BY ALL)
SELECT m.query_id, cand_rank, round(sum(m), 6) AS a_sum, any_value(na.train_id) AS a_id, any_value(nb.train_id) AS b_id
FROM m JOIN na ON na.query_id = m.query_id AND na.rank = cand_rank JOIN nb ON nb.query_id = m.query_id AND nb.rank = cand_rank GROUP BY ALL""")
def prototype_synthesis(spark, d):
    """A median branch and an anchored branch, as many candidates as the shorter list."""
    a, b = _near(spark, d, 4, "euclidean", 1, 32), _near(spark, d, 6, "manhattan", 33, 32)
    out = combine.synthesis({"a": (a, embeddings(spark, d, 1, 32))}, {"b": b}, 10)
    return out.select(
        "query_id", "cand_rank", F.round(F.aggregate(F.col("num")["a"], F.lit(0.0), lambda x, y: x + y), 6).alias("a_sum"),
        F.col("anchors")["a"].alias("a_id"), F.col("anchors")["b"].alias("b_id")
    )


# ---------------------------------------------------------------- time series

def user_series(spark, d) -> DataFrame:
    """Users' daily event counts by type over the table's days, channel-major; the class is the parity of a user's events."""
    e = table(spark, d, "events").select(
        F.col("user_id").cast("long").alias("sample_id"), F.to_date("ts").alias("day"), "event_type"
    ).where("sample_id IS NOT NULL AND day IS NOT NULL AND event_type IS NOT NULL")
    frame = e.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.array_sort(F.collect_set("event_type")).alias("kinds"))  # one row
    counts = e.repartition("sample_id").groupBy("sample_id", "event_type", "day").agg(F.count("*").alias("n"))  # the one shuffle
    each = counts.groupBy("sample_id", "event_type").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.col("n").cast("double")))).alias("m"), F.sum("n").alias("n")
    )
    per = each.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("m"), F.sum("n").alias("total"))
    days = F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))
    one = lambda m: F.transform(days, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0.0)))
    value = F.transform(F.transform("kinds", lambda kind: F.try_element_at(F.col("m"), kind)), one)
    out = per.crossJoin(F.broadcast(frame)).select("sample_id", value.alias("value"), (F.col("total") % 2).cast("int").alias("label"))
    return written(out, "series")  # read by several searches and joins


_SERIES = """fr AS (SELECT min(ts::DATE) AS f, date_diff('day', min(ts::DATE), max(ts::DATE)) + 1 AS days FROM events),
ev AS (SELECT user_id::BIGINT AS id, event_type AS ch, date_diff('day', f, ts::DATE) AS t FROM events, fr WHERE user_id IS NOT NULL
 AND event_type IS NOT NULL AND ts IS NOT NULL),
cn AS (SELECT id, ch, t, count(*)::DOUBLE AS n FROM ev GROUP BY ALL),
us AS (SELECT id, (sum(n) % 2)::INT AS label FROM cn GROUP BY 1),
gr AS (SELECT us.id, label, k.ch, t.t, coalesce(n, 0.0) AS n FROM us CROSS JOIN (SELECT DISTINCT ch FROM cn) k CROSS JOIN (SELECT unnest(range(0,
 days)) AS t FROM fr) t LEFT JOIN cn ON cn.id = us.id AND cn.ch = k.ch AND cn.t = t.t)"""
_TS_NEAR = """dc AS (SELECT q.id AS query_id, c.id AS train_id, q.ch, sqrt(sum((q.n - c.n) * (q.n - c.n))) AS x FROM gr q JOIN gr c ON q.ch = c.ch
 AND q.t = c.t WHERE q.label = 1 AND c.label = 0 GROUP BY ALL),
ds AS (SELECT query_id, train_id, sum(x) AS distance FROM dc GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), train_id))::INT AS rank FROM ds)
 WHERE rank <= 5)"""


def _ts_near(spark, d, metric, k=5, rows=None):
    s = user_series(spark, d) if rows is None else rows
    return knn(s.where("label = 1"), s.where("label = 0"), k, metric, "series", digits=9)


#: Recursions folded over lists: a step's list is the next row of the table of all pairs of steps, which begins with column 0.
_ROW = "list_reduce(list_transform(range(1, len({b}) + 1), lambda j: {cell}), lambda r, x: list_append(r, {next}), [{first}])"
_FOLD = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i::DOUBLE]), lambda p, e: {row}, {start})[len({b}) + 1]"
_INF = "'inf'::DOUBLE"


def _fold(a: str, b: str, cell: str, step: str, first: str, start: str) -> str:
    return _FOLD.format(a=a, b=b, start=start, row=_ROW.format(b=b, cell=cell, next=step, first=first))


def _warp_fold(a: str, b: str, cost: str, inside: str) -> str:
    return _fold(
        a, b, f"CASE WHEN {inside} THEN [{cost}, least(p[j + 1], p[j])] ELSE [{_INF}, {_INF}] END", "x[1] + least(x[2], r[len(r)])", _INF,
        f"list_concat([0.0::DOUBLE], list_transform({b}, lambda y: {_INF}))"
    )


_MATCHES = "CASE WHEN x[1] = 1 THEN x[3] + 1 ELSE greatest(x[2], r[len(r)]) END"
_ZEROS = "list_concat([0.0::DOUBLE], list_transform({b}, lambda y: 0.0::DOUBLE))"
_BANDED = "abs(e[1] - j) <= floor(0.1 * len(b))"
_CHANNELS = "sc AS (SELECT id, label, ch, list(n ORDER BY t) AS v FROM gr GROUP BY ALL), pc AS (SELECT q.id AS query_id, c.id AS train_id, q.ch, q.v AS a, c.v AS b FROM sc q JOIN sc c ON q.ch = c.ch WHERE q.label = 1 AND c.label = 0)"
_STEPS = "st AS (SELECT id, label, list(v ORDER BY t) AS v FROM (SELECT id, label, t, list(n ORDER BY ch) AS v FROM gr GROUP BY ALL) GROUP BY ALL), pd AS (SELECT q.id AS query_id, c.id AS train_id, q.v AS a, c.v AS b FROM st q JOIN st c ON q.label = 1 AND c.label = 0)"
_DEPENDENT = _warp_fold("a", "b", "list_sum(list_transform(list_zip(a[e[1]::INT], b[j]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "true")


def _ranked(source: str, k: int = 5, name: str = "n") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), train_id))::INT AS rank FROM {source}) WHERE rank <= {k})"


_TS_DEPENDENT = f"{_STEPS}, dd AS (SELECT query_id, train_id, {_DEPENDENT} AS distance FROM pd)"
_LIST = "SELECT query_id, train_id, rank, round(distance, 6) AS distance FROM n"


@_query(f"WITH {_SERIES}, {_TS_NEAR} {_LIST}")
def ts_euclidean_knn(spark, d):
    return _rounded(_ts_near(spark, d, "euclidean"), "distance")


@_query(f"""WITH {_SERIES}, {_CHANNELS}, dx AS (SELECT query_id, train_id,
 {_warp_fold("a", "b", "(a[e[1]::INT] - b[j]) * (a[e[1]::INT] - b[j])", _BANDED)} AS x FROM pc),
ds AS (SELECT query_id, train_id, sum(x) AS distance FROM dx GROUP BY ALL), {_ranked("ds")} {_LIST}""")
def ts_dtw_knn(spark, d):
    """Windowed warping, summed over channels."""
    return _rounded(_ts_near(spark, d, "dtw"), "distance")


@_query(f"""WITH {_SERIES}, {_CHANNELS}, dx AS (SELECT query_id, train_id,
 1 - {_fold("a", "b", f"[CASE WHEN {_BANDED} AND abs(a[e[1]::INT] - b[j]) <= 1 THEN 1.0 ELSE 0.0 END, p[j + 1], p[j]]", _MATCHES, "0.0::DOUBLE", _ZEROS.format(b="b"))} / len(b) AS x FROM pc),
ds AS (SELECT query_id, train_id, sum(x) AS distance FROM dx GROUP BY ALL), {_ranked("ds")} {_LIST}""")
def ts_lcss_knn(spark, d):
    return _rounded(_ts_near(spark, d, "lcss"), "distance")


@_query(f"WITH {_SERIES}, {_TS_DEPENDENT}, {_ranked('dd')} {_LIST}")
def ts_dtw_dependent_knn(spark, d):
    """One warping path for all channels, without a window."""
    return _rounded(_ts_near(spark, d, "dtw_dependent"), "distance")


@_query(f"""WITH {_SERIES}, m AS (SELECT ch, median(n) AS m FROM gr GROUP BY 1) SELECT ((dense_rank() OVER (ORDER BY ch)) - 1)::INT AS channel,
 round(tau, 6) AS tau
FROM (SELECT gr.ch, 1.1 * median(abs(n - m)) AS tau FROM gr JOIN m USING (ch) GROUP BY 1)""")
def tau_mad(spark, d):
    return _rounded(preprocess.mad_threshold(user_series(spark, d), 1.1), "tau")


@_query(f"""WITH {_SERIES}, {_TS_NEAR}, p AS (SELECT n.query_id, n.rank, q.ch, q.t, q.n AS a, c.n AS b FROM n JOIN gr q ON q.id = n.query_id JOIN gr c
 ON c.id = n.train_id AND c.ch = q.ch AND c.t = q.t)
SELECT query_id, rank, round(avg(abs(a - b)), 6) AS proximity, round(avg((a <> b)::INT), 6) AS sparsity FROM p GROUP BY ALL""")
def ts_proximity_sparsity(spark, d):
    s = user_series(spark, d)
    n = _ts_near(spark, d, "euclidean", rows=s)
    j = n.join(
        s.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a")), "query_id"
    ).join(s.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b")), "train_id")
    return _rounded(
        j.select(
            "query_id", "rank", series.proximity(F.col("a"), F.col("b")).alias("proximity"),
            series.sparsity(F.col("a"), F.col("b")).alias("sparsity")
        ),
        "proximity", "sparsity"
    )


@_query(f"""WITH {_SERIES}, {_TS_NEAR}, i AS (SELECT query_id, rank AS cand_rank, max(rank) OVER (PARTITION BY query_id) AS k FROM n),
x AS (SELECT i.query_id, cand_rank, gr.ch, gr.t, median(gr.n) AS m FROM i JOIN n ON n.query_id = i.query_id AND n.rank <= least(2 * cand_rank - 1, k)
 JOIN gr ON gr.id = n.train_id GROUP BY ALL)
SELECT query_id, cand_rank, round(sum(m), 6) AS total FROM x GROUP BY ALL""")
def ts_progressive_median(spark, d):
    s = user_series(spark, d)
    out = combine.progressive_series_medians(_ts_near(spark, d, "euclidean", rows=s), s)
    return out.select("query_id", "cand_rank", F.round(F.aggregate(F.flatten("value"), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@_query(f"""WITH {_SERIES}, f AS (SELECT id AS vec_id, label, list(m ORDER BY ch) AS v FROM (SELECT id, label, ch, avg(n) AS m FROM gr GROUP BY ALL)
 GROUP BY ALL),
{_knn_cte("n", "euclidean", 3, where="q.label = 1 AND c.label = 0", source="f", by="round(distance, 9)")} SELECT query_id, train_id, rank, round(distance, 6) AS distance FROM n""")
def early_fusion_time_means(spark, d):
    """Series reduced to their channels' means, then searched as vectors."""
    s = user_series(spark, d).withColumn("value", series.time_mean(F.col("value")))
    return _rounded(knn(s.where("label = 1"), s.where("label = 0"), 3, "euclidean", digits=9), "distance")


# ---------------------------------------------------------------- plausibility and objectives

K_LOF = 10
_LOF = f"""WITH {_E}, ref AS (SELECT * FROM e WHERE label = {TARGET}),
n0 AS (SELECT * FROM (SELECT q.vec_id AS id, c.vec_id AS nb, {_DISTANCES["euclidean"].format(v="v")} AS d, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY {_DISTANCES["euclidean"].format(v="v")}, c.vec_id) AS r FROM ref q JOIN ref c ON q.vec_id <> c.vec_id) WHERE r <= {K_LOF}),
kd AS (SELECT id, max(d) AS kd FROM n0 GROUP BY 1), lr AS (SELECT n0.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n0 JOIN kd ON kd.id = n0.nb
 GROUP BY 1),
n1 AS (SELECT * FROM (SELECT q.vec_id AS id, q.label, c.vec_id AS nb, {_DISTANCES["euclidean"].format(v="v")} AS d, row_number()
 OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCES["euclidean"].format(v="v")}, c.vec_id) AS r FROM e q JOIN ref c ON true) WHERE r <= {K_LOF}),
s AS (SELECT n1.id, any_value(label) AS label, avg(lrd) * (avg(greatest(d, kd)) + 1e-10) AS lof FROM n1 JOIN kd ON kd.id = n1.nb JOIN lr
 ON lr.id = n1.nb GROUP BY 1)"""


def _lof_scores(spark, d):
    e = embeddings(spark, d)
    fitted = written(lof.fit(e.where(F.col("label") == TARGET), K_LOF), "fitted")  # read by the search and after it
    return lof.score(fitted, e, K_LOF).join(e.select("sample_id", "label"), "sample_id")


@_query(f"{_LOF} SELECT id AS sample_id, round(lof, 6) AS lof FROM s")
def lof_score(spark, d):
    """Outlier factors of all embeddings against the target class; its own rows count as new points."""
    return _rounded(_lof_scores(spark, d).select("sample_id", "lof"), "lof")


@_query(f"{_LOF}, q AS (SELECT *, round(lof, 9) AS x FROM s), f AS (SELECT x FROM q WHERE label = {TARGET}) SELECT id AS sample_id, round((SELECT count(*) FROM f WHERE f.x <= q.x) / (SELECT count(*) FROM f), 6) AS plausibility FROM q")
def lof_percentile(spark, d):
    s = written(_lof_scores(spark, d).withColumn("lof", F.round("lof", 9)), "factors")
    out = scores.with_percentile_rank(s, "lof", s.where(F.col("label") == TARGET), "lof", "plausibility")
    return _rounded(out.select("sample_id", "plausibility"), "plausibility")


@_query(f"""{_LOF}, b AS (SELECT quantile_cont(lof, 0.05) AS low, quantile_cont(lof, 0.95) AS high FROM s WHERE label = {TARGET})
SELECT id AS sample_id, round(least(greatest((lof - low) / (high - low), 0), 1), 6) AS plausibility FROM s, b""")
def lof_unit_interval(spark, d):
    s = written(_lof_scores(spark, d), "factors")  # else the bounds would search once more
    low, high = lof.bounds(s.where(F.col("label") == TARGET)).first()
    return s.select("sample_id", F.round(scores.unit_interval(F.col("lof"), F.lit(low), F.lit(high)), 6).alias("plausibility"))


_PAIRS = f"WITH {_E}, {_knn_cte('n', 'euclidean', 5)}, p AS (SELECT n.query_id, n.rank, q.v AS a, c.v AS b, q.label AS ql, c.label AS cl FROM n JOIN e q ON q.vec_id = n.query_id JOIN e c ON c.vec_id = n.train_id)"


def _pairs(spark, d):
    e = embeddings(spark, d)
    n = _near(spark, d, 5, "euclidean")
    return n.join(
        e.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a"), F.col("label").alias("ql")), "query_id"
    ).join(e.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b"), F.col("label").alias("cl")), "train_id")


@_query(f"""{_PAIRS} SELECT query_id, rank, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 64, 6) AS proximity,
round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> z[2])::INT)) / 64, 6) AS sparsity,
round(least(greatest((1 - list_inner_product(a, b)) / 2, 0), 1), 6) AS embedding_proximity, round((1 - list_cosine_similarity(a, b)) / 2, 6)
 AS image_proximity,
round(list_sum(list_transform(list_zip(a, b), lambda z: (abs(z[1] - z[2]) > 0.1)::INT)) / 64, 6) AS image_sparsity, abs(cl - {TARGET})::DOUBLE
 AS outcome FROM p""")
def vector_objectives(spark, d):
    """Outcome, proximity and sparsity of each nearest neighbour taken as a candidate."""
    p, a, b = _pairs(spark, d), F.col("a"), F.col("b")
    scaled_off = scores.image_sparsity(F.transform(a, lambda x: x), F.transform(b, lambda x: x), 0.1)
    raw = F.aggregate(F.zip_with(a, b, lambda x, y: (F.abs(x - y) > 0.1).cast("double")), F.lit(0.0), lambda s, v: s + v) / 64
    sparse = F.when((F.array_max(a) <= 1) & (F.array_max(b) <= 1), scaled_off).otherwise(raw)
    out = p.select(
        "query_id", "rank", scores.tabular_proximity(a, b).alias("proximity"), scores.tabular_sparsity(a, b).alias("sparsity"),
        scores.embedding_proximity(a, b).alias("embedding_proximity"), scores.cosine_proximity(a, b).alias("image_proximity"),
        sparse.alias("image_sparsity"), scores.outcome(F.col("cl"), F.lit(TARGET)).alias("outcome")
    )
    return _rounded(out, "proximity", "sparsity", "embedding_proximity", "image_proximity", "image_sparsity")


@_query(f"""{_PAIRS} SELECT query_id, rank, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 64, 6) AS baseline_proximity,
(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] <> z[2])::INT)))::DOUBLE AS baseline_changed, round(1 - list_cosine_similarity(a, b), 6)
 AS baseline_cosine FROM p""")
def baseline_objectives(spark, d):
    p, a, b = _pairs(spark, d), F.col("a"), F.col("b")
    near, changed = scores.baseline_tabular(a, b)
    cosine, _ = scores.baseline_embedding(a, b)
    return _rounded(
        p.select("query_id", "rank", near.alias("baseline_proximity"), changed.alias("baseline_changed"), cosine.alias("baseline_cosine")),
        "baseline_proximity", "baseline_cosine"
    )


@_query("""SELECT doc_id AS sample_id, abs(toxic - 0)::DOUBLE AS outcome, quality <> toxic AS flipped FROM labels""")
def outcome_flip(spark, d):
    t = table(spark, d, "labels")
    return t.select(
        F.col("doc_id").alias("sample_id"), scores.outcome(F.col("toxic"), F.lit(0)).alias("outcome"),
        scores.flipped(F.col("quality"), F.col("toxic")).alias("flipped")
    )


@_query(f"""WITH {_HALVES}, {_knn_cte("n", "euclidean", 3)}, p AS (SELECT n.query_id, n.rank, q.a AS qa, c.a AS ca, q.b AS qb, c.b AS cb, c.label
 AS cl FROM n JOIN e q ON q.vec_id = n.query_id JOIN e c ON c.vec_id = n.train_id)
SELECT query_id, rank, cl::DOUBLE AS outcome, round(0.75 * list_sum(list_transform(list_zip(qa, ca), lambda z: abs(z[1] - z[2]))) / 32 + 0.25
 * least(greatest((1 - list_inner_product(qb, cb)) / 2, 0), 1), 6) AS proximity,
round(0.75 * list_sum(list_transform(list_zip(qa, ca), lambda z: (z[1] <> z[2])::INT)) / 32, 6) AS sparsity FROM p""")
def objectives_assembled(spark, d):
    """Two modalities weighted 3 : 1; the second has no sparsity, and its weight is not spread."""
    a, b = embeddings(spark, d, 1, 32), embeddings(spark, d, 33, 32)
    n = _near(spark, d, 3, "euclidean")
    for side, key in (("q", "query_id"), ("c", "train_id")):
        for name, df in (("a", a), ("b", b)):
            n = n.join(
                df.select(
                    F.col("sample_id").alias(key), F.col("value").alias(f"{side}{name}"),
                    *([F.col("label").alias("cl")] if side + name == "ca" else [])
                ),
                key
            )
    w = {"tab": 3.0, "text": 1.0}
    return n.select("query_id", "rank", scores.outcome(F.col("cl"), F.lit(TARGET)).alias("outcome"), F.round(
        scores.weighted({"tab": scores.tabular_proximity(F.col("qa"), F.col("ca")), "text": scores.embedding_proximity(F.col("qb"), F.col("cb"))}, w),
        6
    ).alias("proximity"),
                    F.round(
                        scores.weighted({"tab": scores.tabular_sparsity(F.col("qa"), F.col("ca")), "text": F.lit(None).cast("double")}, w),
                        6
                    ).alias("sparsity"))


# ---------------------------------------------------------------- text

_TOK = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
_TEXTS = f"""q AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_TOK}'), lambda t: t <> '') AS w
 FROM benchmark),
ci AS (SELECT *, (row_number() OVER (ORDER BY conv_id % 64, conv_id, turn) - 1)::BIGINT AS id FROM conversations WHERE role = 'assistant'),
c AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_TOK}'), lambda t: t <> '') AS w FROM ci)"""


def _texts(spark, d):
    """Benchmark texts and the assistant's turns, these by their number in the order of conversation and turn."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("sample_id"), text.tokens(F.col("text")).alias("value"), "text")
    c = preprocess.numbered(table(spark, d, "conversations").where("role = 'assistant'"), F.col("conv_id") % 64, ["conv_id", "turn"], "sample_id")
    return b, c.select("sample_id", text.tokens(F.col("text")).alias("value"), "text")


def _rouge_sql(n: int) -> str:
    gram = "t" if n == 1 else "t || ' ' || lead(t) OVER (PARTITION BY id ORDER BY i)"
    each = lambda s: f"{s}g AS (SELECT id, g, count(*) AS n FROM (SELECT id, {gram} AS g FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {s})) WHERE g IS NOT NULL GROUP BY ALL), {s}n AS (SELECT id, greatest(len(w) - {n - 1}, 0) AS n FROM {s})"
    return f"""WITH {_TEXTS}, {each("q")}, {each("c")}, o AS (SELECT qg.id AS q, cg.id AS c, sum(least(qg.n, cg.n)) AS o FROM qg JOIN cg
 ON qg.g = cg.g GROUP BY ALL),
x AS (SELECT qn.id AS query_id, cn.id AS train_id, round(1 - CASE WHEN qn.n = 0 AND cn.n = 0 THEN 1.0 WHEN qn.n = 0 OR cn.n = 0 THEN 0.0 ELSE 2.0
 * coalesce(o.o, 0) / (qn.n + cn.n) END, 9) AS distance FROM qn CROSS JOIN cn LEFT JOIN o ON o.q = qn.id AND o.c = cn.id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id))::INT AS rank FROM x) SELECT query_id::BIGINT AS query_id,
 train_id::BIGINT AS train_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 3"""


def _text_knn(spark, d, metric):
    q, c = _texts(spark, d)
    return _rounded(knn(q, c, 3, metric, "text", digits=9), "distance")


#: Tokens that only one of a pair holds can't be in a common subsequence.
_COMMON = _fold("a", "b", "[CASE WHEN a[e[1]::INT] = b[j] THEN 1.0 ELSE 0.0 END, p[j + 1], p[j]]", _MATCHES, "0.0::DOUBLE", _ZEROS.format(b="b"))
_LCS = f"""WITH {_TEXTS}, pr AS (SELECT q.id AS query_id, c.id AS train_id, len(q.w) AS n, len(c.w) AS m, list_filter(q.w,
 lambda t: list_contains(c.w, t)) AS a, list_filter(c.w, lambda t: list_contains(q.w, t)) AS b FROM q, c),
lc AS (SELECT query_id, train_id, n, m, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {_COMMON} END AS l FROM pr)"""
_PICKED = "SELECT query_id::BIGINT AS query_id, train_id::BIGINT AS train_id, rank, round(distance, 6) AS distance FROM n"


def _bleu_sql() -> str:
    grams = []
    for n in range(1, 5):
        gram = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(n))
        for side in "qc":
            grams.append(
                f"{side}{n} AS (SELECT id, g, count(*) AS k FROM (SELECT id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS g FROM {side}) GROUP BY ALL)"
            )
        grams.append(f"o{n} AS (SELECT x.id AS q, y.id AS c, sum(least(x.k, y.k)) AS o FROM q{n} x JOIN c{n} y USING (g) GROUP BY ALL)")
    logs = " + ".join(
        f"CASE WHEN {n} <= k THEN ln(greatest((coalesce(o{n}.o, 0) + 1e-12) / (m - {n - 1} + 1e-12), 1e-12)) ELSE 0 END"
        for n in range(1, 5)
    )
    joins = " ".join(f"LEFT JOIN o{n} ON o{n}.q = p.query_id AND o{n}.c = p.train_id" for n in range(1, 5))
    return f"""WITH {_TEXTS}, {", ".join(grams)}, p AS (SELECT q.id AS query_id, c.id AS train_id, len(q.w) AS n, len(c.w) AS m, least(4, len(c.w),
 greatest(len(q.w), 1)) AS k FROM q, c),
ds AS (SELECT query_id, train_id, 1 - CASE WHEN m = 0 THEN (n = 0)::INT ELSE least(1, greatest(0, CASE WHEN m > n THEN 1 ELSE exp(1 - n / m) END
 * exp(({logs}) / greatest(k, 1)))) END AS distance FROM p {joins}),
{_ranked("ds", 3)} {_PICKED}"""


@_query(_rouge_sql(1))
def text_rouge1_knn(spark, d):
    return _text_knn(spark, d, "rouge_1")


@_query(_rouge_sql(2))
def text_rouge2_knn(spark, d):
    return _text_knn(spark, d, "rouge_2")


@_query(f"{_LCS}, ds AS (SELECT query_id, train_id, 1 - CASE WHEN n = 0 OR m = 0 THEN (n + m = 0)::INT ELSE 2 * l / (n + m) END AS distance FROM lc), {_ranked('ds', 3)} {_PICKED}")
def text_rouge_l_knn(spark, d):
    return _text_knn(spark, d, "rouge_l")


@_query(f"{_LCS}, ds AS (SELECT query_id, train_id, 1 - CASE WHEN n + m = 0 THEN 1 ELSE l / greatest(n, m) END AS distance FROM lc), {_ranked('ds', 3)} {_PICKED}")
def text_lcs_knn(spark, d):
    return _text_knn(spark, d, "lcs")


@_query(_bleu_sql())
def text_bleu_knn(spark, d):
    return _text_knn(spark, d, "bleu")


_EDITS = _fold(
    "a", "b", "[p[j + 1] + 1, p[j] + CASE WHEN a[e[1]::INT] = b[j] THEN 0 ELSE 1 END]", "least(x[1], x[2], r[len(r)] + 1)", "e[1]",
    "list_transform(range(0, len(b) + 1), lambda y: y::DOUBLE)"
)


@_query(f"""{_rouge_sql(1).rsplit("SELECT query_id::BIGINT", 1)[0]}, pr AS (SELECT query_id, train_id, q.w AS a, c.w AS b FROM r JOIN q
 ON q.id = query_id JOIN c ON c.id = train_id WHERE rank = 1)
SELECT query_id::BIGINT AS query_id, train_id::BIGINT AS train_id, round(CASE WHEN len(a) = 0 THEN len(b) WHEN len(b) = 0 THEN len(a)
 ELSE {_EDITS} END / greatest(len(a), 1), 6) AS sparsity FROM pr""")
def text_edit_sparsity(spark, d):
    """Token edits between each benchmark text and its nearest text."""
    q, c = _texts(spark, d)
    n = _text_knn(spark, d, "rouge_1").where("rank = 1")
    j = n.join(
        q.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a")), "query_id"
    ).join(c.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b")), "train_id")
    return j.select("query_id", "train_id", F.round(text.edit_sparsity(F.col("a"), F.col("b")), 6).alias("sparsity"))


_WORDS = r"[\p{L}\p{N}_]{2,}"
_TFIDF = f"""q0 AS (SELECT item_id::BIGINT AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}')) AS t FROM benchmark),
ci AS (SELECT *, (row_number() OVER (ORDER BY conv_id % 64, conv_id, turn) - 1)::BIGINT AS id FROM conversations WHERE role = 'assistant'),
c0 AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}')) AS t FROM ci),
idf AS (SELECT t, ln((1.0 + (SELECT count(*) FROM conversations WHERE role = 'assistant')) / (1 + count(DISTINCT id))) + 1 AS idf FROM c0 GROUP BY 1),
qw AS (SELECT id, t, n * idf AS w FROM (SELECT id, t, count(*) AS n FROM q0 GROUP BY ALL) JOIN idf USING (t)), cw AS (SELECT id, t, n * idf AS w
 FROM (SELECT id, t, count(*) AS n FROM c0 GROUP BY ALL) JOIN idf USING (t)),
qs AS (SELECT id, sqrt(sum(w * w)) AS s FROM qw GROUP BY 1), cs AS (SELECT id, sqrt(sum(w * w)) AS s FROM cw GROUP BY 1),
qv AS (SELECT id, t, w / s AS w FROM qw JOIN qs USING (id)), cv AS (SELECT id, t, w / s AS w FROM cw JOIN cs USING (id))"""


@_query(f"""WITH {_TFIDF}, x AS (SELECT qv.id AS q, cv.id AS c, sum(qv.w * cv.w) AS dot FROM qv JOIN cv ON qv.t = cv.t GROUP BY ALL),
ds AS (SELECT item_id::BIGINT AS query_id, ci.id AS train_id, 1 - coalesce(dot, 0) AS distance FROM benchmark CROSS JOIN ci LEFT JOIN x ON q = item_id
 AND c = ci.id), {_ranked("ds", 3)} {_LIST}""")
def tfidf_knn(spark, d):
    q, c = (written(t.select("sample_id", "text"), "texts") for t in _texts(spark, d))
    fitted = encoders.numbered_terms(encoders.tfidf_fit(c))
    sparse = lambda t: written(encoders.gathered_terms(encoders.tfidf_transform(t, fitted), t), "sparse")
    return _rounded(encoders.sparse_cosine_knn(sparse(q), sparse(c), 3), "distance")


@_query(f"WITH {_TFIDF} SELECT id AS sample_id, count(*) AS n_terms, round(max(w), 6) AS top_weight FROM cv GROUP BY 1")
def tfidf_vectors(spark, d):
    c = _texts(spark, d)[1]
    return encoders.tfidf_transform(c, encoders.tfidf_fit(c)).groupBy("sample_id").agg(
        F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight")
    )


@_query(f"""WITH {_TEXTS}, e AS (SELECT row_number() OVER (ORDER BY vec_id % 64, vec_id) - 1 AS number, list_transform(embedding, lambda x: x::DOUBLE)
 AS v FROM embeddings),
u AS (SELECT id, unnest(w) AS t FROM q), x AS (SELECT id, v FROM u JOIN e ON number = ('0x' || substr(md5('7:' || t), 1,
 8))::BIGINT % (SELECT count(*) FROM embeddings)),
m AS (SELECT id, dim, avg(x) AS m FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM x) GROUP BY ALL)
SELECT q.id::BIGINT AS sample_id, round(coalesce(sum(m), 0), 6) AS value_sum, round(coalesce(max(m) FILTER (dim = 7), 0), 6) AS value_7 FROM q LEFT
 JOIN m USING (id) GROUP BY q.id""")
def word_vector_mean(spark, d):
    """Averages of word vectors; a hash of the word draws its embedding."""
    q, e = _texts(spark, d)[0], embeddings(spark, d)
    known = q.select(F.explode("value").alias("word")).distinct().withColumn("number", preprocess.draw(7, F.col("word")) % F.lit(max(e.count(), 1)))
    vecs = known.join(preprocess.numbered(e, F.col("sample_id") % 64, ["sample_id"], "number"), "number").select("word", F.col("value").alias("vec"))
    return _digest(encoders.word_vector_mean(q, vecs, 64), "sample_id")


_MET = f"""dw AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_TOK}'), lambda t: t <> '') AS w FROM documents),
wt AS (SELECT doc, i, w[i] AS t FROM (SELECT row_number() OVER () AS doc, w, unnest(range(1, len(w) + 1)) AS i FROM dw)),
near AS (SELECT l.t AS a, r.t AS b, count(*) AS n FROM wt l JOIN (SELECT unnest(range(1, 5)) AS gap) g ON true JOIN wt r ON r.doc = l.doc
 AND r.i = l.i + g.gap GROUP BY ALL),
pairs AS (SELECT a, b, sum(n)::DOUBLE AS n FROM (SELECT a, b, n FROM near UNION ALL SELECT b, a, n FROM near) GROUP BY ALL),
tot AS (SELECT a, sum(n) AS n FROM pairs GROUP BY 1),
parts AS (SELECT p.a, ('0x' || substr(md5('0:' || p.b), 1, 8))::BIGINT % 64 AS place, sum(greatest(ln(p.n * (SELECT sum(n) FROM pairs)
 / (x.n * y.n)), 0) * (('0x' || substr(md5('1:' || p.b), 1, 8))::BIGINT % 2 * 2 - 1)) AS x FROM pairs p JOIN tot x ON x.a = p.a JOIN tot y ON y.a = p.b
 GROUP BY ALL),
vec AS (SELECT a, place, x / s AS x FROM parts JOIN (SELECT a, greatest(sqrt(sum(x * x)), 1e-8) AS s FROM parts GROUP BY 1) USING (a))"""


@_query(f"""WITH {_TEXTS}, {_MET}, u AS (SELECT id, unnest(w) AS t FROM q), k AS (SELECT id, count(*) AS k FROM u WHERE t IN (SELECT a FROM tot) GROUP BY 1),
m AS (SELECT u.id, place, sum(x) / any_value(k) AS m FROM u JOIN vec ON a = t JOIN k ON k.id = u.id GROUP BY u.id, place)
SELECT q.id::BIGINT AS sample_id, round(coalesce(sum(m), 0), 6) AS value_sum, round(coalesce(max(m) FILTER (place = 6), 0), 6) AS value_7 FROM q LEFT
 JOIN m USING (id) GROUP BY q.id""")
def cooccurrence_vector_mean(spark, d):
    """Averages of word vectors that are learned from the neighbours of each word in all documents."""
    q = _texts(spark, d)[0]
    vecs = encoders.cooccurrence_vectors(table(spark, d, "documents").select("text"), only=q.select(F.explode("value").alias("word")))
    return _digest(encoders.word_vector_mean(q, vecs, 64), "sample_id")


@_query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS body,
 regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') AS domain FROM pages""")
def html_clean_domain(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("body"), text.url_domain(F.col("url")).alias("domain"))


# ---------------------------------------------------------------- score tables

def sweep_scores(spark, d) -> DataFrame:
    """A score table: each customer's orders as candidates, their state as configuration and their priority as generator."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("generator"), F.col("o_orderstatus").alias("config"),
                    F.row_number().over(_by_query()).alias("cand_rank"), (F.col("o_orderkey") % 2).cast("double").alias("outcome"), (F.col("o_totalprice").cast("double") / 1e4).alias("proximity"), F.when(
                        F.col("o_orderkey") % 7 == 0, float("nan")
                    ).otherwise(F.col("o_orderkey") % 11).cast("double").alias("sparsity"), F.month("o_orderdate").cast("double").alias("plausibility"))


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")


_SWEEP = """s AS (SELECT o_custkey AS query_id, o_orderpriority AS generator, o_orderstatus AS config, row_number() OVER (PARTITION BY o_custkey,
 o_orderpriority ORDER BY o_orderkey) AS cand_rank,
(o_orderkey % 2)::DOUBLE AS outcome, o_totalprice::DOUBLE / 1e4 AS proximity, CASE WHEN o_orderkey % 7 = 0 THEN NULL
 ELSE (o_orderkey % 11)::DOUBLE END AS sparsity, month(o_orderdate)::DOUBLE AS plausibility FROM orders)"""
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in analytics.OBJECTIVES)


@_query(f"WITH {_SWEEP} SELECT k, generator, {_MEANS}, count(*) AS n FROM s JOIN (VALUES (1), (5), (10), (20), (50)) v(k) ON cand_rank <= k GROUP BY ALL")
def k_curve(spark, d):
    return _rounded(analytics.k_curve(sweep_scores(spark, d), [1, 5, 10, 20, 50]), *analytics.OBJECTIVES)


@_query(f"WITH {_SWEEP}, m AS (SELECT generator, config, avg(proximity) AS p FROM s GROUP BY ALL) SELECT generator, config, round(p, 6) AS proximity FROM m QUALIFY rank() OVER (PARTITION BY generator ORDER BY p) = 1")
def best_config(spark, d):
    return _rounded(analytics.best_configs(sweep_scores(spark, d), ["generator"], ["config"], "proximity"), "proximity")


@_query(f"""WITH {_SWEEP} SELECT generator, {", ".join(f"round(avg(sparsity) FILTER (config = '{c}'), 4) AS {c.lower()}" for c in "FOP")} FROM s
 GROUP BY 1""")
def pivot_means(spark, d):
    out = analytics.pivot_means(sweep_scores(spark, d), "generator", "config", ["F", "O", "P"], "sparsity")
    return out.select("generator", *[F.col(c).alias(c.lower()) for c in "FOP"])


@_query(f"""WITH {_SWEEP} SELECT generator, config, {", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std" for c in analytics.OBJECTIVES)} FROM s GROUP BY ALL""")
def summary_mean_std(spark, d):
    return analytics.summary(sweep_scores(spark, d), ["generator", "config"])


@_query(f"WITH {_SWEEP}, m AS (SELECT generator, config, {', '.join(f'avg({c}) AS {c}' for c in analytics.OBJECTIVES)} FROM s GROUP BY ALL) SELECT generator, {_MEANS} FROM m GROUP BY 1")
def mean_of_config_means(spark, d):
    return _rounded(analytics.mean_of_means(sweep_scores(spark, d), ["generator", "config"], ["generator"]), *analytics.OBJECTIVES)


@_query("""WITH p AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS a, -date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS b
 FROM orders)
SELECT id, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a <= p.a AND q.b <= p.b AND (q.a < p.a OR q.b < p.b))""")
def pareto_front(spark, d):
    """The cheapest and latest orders: smaller price and smaller negative age."""
    p = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("a"),
        (-F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))).cast("double").alias("b")
    )
    return analytics.pareto_front(p, ["a", "b"], "id")


@_query("""WITH r AS (SELECT o_orderpriority AS generator, o_custkey AS run, count(*) AS n_candidates, 4 AS n_samples, sum(o_totalprice::DOUBLE) / 1e5
 AS runtime_sec FROM orders GROUP BY ALL),
m AS (SELECT *, avg(n_samples) OVER (PARTITION BY generator) AS n FROM r)
SELECT generator, round(avg(n_candidates / n_samples), 6) AS coverage, round(avg((n_candidates > 1)::INT), 6) AS flip_rate, round(avg(runtime_sec
 / n), 6) AS sec_per_sample FROM m GROUP BY 1""")
def coverage_runtime(spark, d):
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("generator"), F.col("o_custkey").alias("run")).agg(
        F.count("*").alias("n_candidates"), F.lit(4).alias("n_samples"),
        (F.sum(F.col("o_totalprice").cast("double")) / 1e5).alias("runtime_sec"), (F.count("*") - 1).alias("n_feasible")
    )
    cover = analytics.coverage(r).groupBy("generator").agg(F.avg("coverage").alias("coverage"))
    return _rounded(
        cover.join(analytics.flip_rate(r, ["generator"]), "generator").join(analytics.runtime_per_sample(r, ["generator"]), "generator"),
        "coverage", "flip_rate", "sec_per_sample"
    )


@_query("""WITH s AS (SELECT quality AS y, floor(n_chars / 100) AS x FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, avg(x) OVER () AS z,
 rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)
 * count(*) FILTER (y = 0)), 6) AS auroc FROM r""")
def auroc(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), F.floor(F.col("n_chars") / 100).alias("score")
    )
    return _rounded(analytics.auroc(rows), "auroc")


_REPORT = """WITH p AS (SELECT quality AS y, 1 - toxic AS p FROM labels), c AS (SELECT DISTINCT y AS cls FROM p UNION SELECT DISTINCT p FROM p),
t AS (SELECT cls, count(*) FILTER (y = cls AND p = cls) AS tp, count(*) FILTER (y = cls) AS support, count(*) FILTER (p = cls) AS said FROM c, p
 GROUP BY 1),
m AS (SELECT cls, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE
 WHEN said + support > 0 THEN 2.0 * tp / (said + support) ELSE 0 END AS f1, support FROM t)"""


def _predictions(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred"))


@_query(f"{_REPORT} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m")
def class_report(spark, d):
    return _rounded(analytics.class_report(_predictions(spark, d)), "precision", "recall", "f1")


@_query(f"{_REPORT} SELECT round(avg(f1), 6) AS macro_f1, round((SELECT avg((y = p)::INT) FROM p), 6) AS accuracy FROM m")
def macro_f1(spark, d):
    return _rounded(analytics.macro_metrics(_predictions(spark, d)), "macro_f1", "accuracy")


# ---------------------------------------------------------------- preparation

@_query(f"WITH {_CUST}, m AS (SELECT avg(balance) AS mb, stddev_pop(balance) AS sb, avg(total) AS mt, stddev_pop(total) AS st FROM cu WHERE label <> 'MACHINERY') SELECT vec_id AS sample_id, round((balance - mb) / sb, 6) AS balance, round((total - mt) / st, 6) AS total FROM cu, m")
def standard_scale(spark, d):
    """Fitted on all segments but one, applied to all rows."""
    out = preprocess.standard_scale(customers(spark, d), ["balance", "total"], F.col("segment") != "MACHINERY")
    return _rounded(out.select("sample_id", "balance", "total"), "balance", "total")


@_query("""WITH v AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM (SELECT DISTINCT o_orderpriority
 FROM orders WHERE o_orderpriority <> '5-LOW'))
SELECT o_orderkey AS sample_id, coalesce(code, -1) AS code FROM orders LEFT JOIN v USING (o_orderpriority)""")
def ordinal_encode(spark, d):
    """Orders of one priority are left out of the fit, so theirs is unknown."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderpriority")
    return preprocess.ordinal_codes(o, "o_orderpriority", F.col("o_orderpriority") != "5-LOW", "code").select("sample_id", "code")


@_query("""WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_custkey AS sample_id, round((SELECT count(*)
 FROM customer) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM customer JOIN n USING (c_mktsegment)""")
def balanced_weights(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), "c_mktsegment")
    return _rounded(preprocess.balanced_weights(c, "c_mktsegment").select("sample_id", "weight"), "weight")


@_query("""SELECT 'vec_id' AS name, avg((vec_id IS NULL)::INT)::DOUBLE AS missing, count(DISTINCT vec_id) AS n_distinct FROM embeddings UNION ALL
 SELECT 'label', avg((label IS NULL)::INT)::DOUBLE, count(DISTINCT label) FROM embeddings""")
def missing_share(spark, d):
    return preprocess.missing_share(table(spark, d, "embeddings").select("vec_id", "label"))


@_query("""SELECT 'quality' AS name, CASE WHEN bool_and(quality IN (0, 1)) THEN 'categorical' ELSE 'continuous' END AS kind FROM labels UNION ALL
 SELECT 'doc_id', CASE WHEN bool_and(doc_id IN (0, 1)) THEN 'categorical' ELSE 'continuous' END FROM labels""")
def feature_types(spark, d):
    return preprocess.feature_types(table(spark, d, "labels"), ["quality", "doc_id"])


@_query("SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, month(ts)::INT AS month FROM events")
def date_parts(spark, d):
    return table(spark, d, "events").select("event_id", *preprocess.date_parts(F.col("ts")))


@_query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def top_values(spark, d):
    return analytics.top_values(table(spark, d, "events"), F.array("event_type"), 3)


@_query("""WITH s AS (SELECT doc_id AS sample_id, [quality::DOUBLE, 1.0 - quality] AS a, [1.0 - toxic, toxic::DOUBLE] AS b FROM labels)
 SELECT sample_id, round((a[1] + b[1]) / 2, 6) AS p0, round((a[2] + b[2]) / 2, 6) AS p1 FROM s""")
def late_fusion(spark, d):
    t, one = table(spark, d, "labels"), F.lit(1.0)
    p = preprocess.late_fusion(
        [F.array(F.col("quality").cast("double"), one - F.col("quality")), F.array(one - F.col("toxic"), F.col("toxic").cast("double"))]
    )
    return t.select(F.col("doc_id").alias("sample_id"), F.round(F.get(p, F.lit(0)), 6).alias("p0"), F.round(F.get(p, F.lit(1)), 6).alias("p1"))


@_query("""SELECT c_custkey AS sample_id, c_mktsegment AS label, CASE WHEN percent_rank() OVER (PARTITION BY c_mktsegment
 ORDER BY md5('42:' || c_custkey), c_custkey) < 0.2 THEN 'test' ELSE 'train' END AS split FROM customer""")
def stratified_split(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("label"))
    return preprocess.stratified_split(c, "label")


def _impute_sql(columns: tuple[str, ...], target: str) -> str:
    """The nearest rows that have ``target``, by the distance over the columns that both have."""
    both = [f"(q.{c} IS NOT NULL AND c.{c} IS NOT NULL)" for c in columns]
    total = " + ".join(f"coalesce((q.{c} - c.{c}) * (q.{c} - c.{c}), 0)" for c in columns)
    used = " + ".join(f"{b}::INT" for b in both)
    return f"""x_{target} AS (SELECT q.id, c.id AS nb, c.{target} AS v, sqrt(({total}) * {len(columns)} / ({used})) AS d FROM i q JOIN i c
 ON q.{target} IS NULL AND c.{target} IS NOT NULL WHERE ({used}) > 0),
f_{target} AS (SELECT id, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM x_{target}) WHERE r <= 5
 GROUP BY 1)"""


@_query(f"""WITH {_CUST}, i AS (SELECT vec_id AS id, CASE WHEN balance >= 0 THEN balance END AS balance, n_orders, total FROM cu),
 {_impute_sql(("balance", "n_orders", "total"), "balance")}
SELECT i.id AS sample_id, round(coalesce(i.balance, f_balance.v, (SELECT avg(balance) FROM i)), 6) AS balance, n_orders, round(total, 8) AS total
 FROM i LEFT JOIN f_balance ON f_balance.id = i.id""")
def knn_impute(spark, d):
    """Balances that are below zero are taken for missing."""
    c = customers(spark, d).select("sample_id", F.when(F.col("balance") >= 0, F.col("balance")).alias("balance"), "n_orders", "total")
    return _rounded(_rounded(preprocess.knn_impute(c, ["balance", "n_orders", "total"], 5), "balance"), "total", digits=8)


# ---------------------------------------------------------------- baselines


def busy_first(batch):
    """A toy predictor: class 0 where the first channel's events reach the mean of all channels', else class 1."""
    import numpy as np

    x = np.asarray(batch, float)
    hit = (x[:, 0].sum(1) >= x.sum((1, 2)) / x.shape[1]).astype(float)
    return np.stack([hit, 1 - hit], 1)


def heavy_first(batch):
    """A toy predictor: class 0 where the first half of a vector sums to more than the second, else class 1."""
    import numpy as np

    x = np.asarray(batch, float)
    half = x.shape[1] // 2
    hit = (x[:, :half].sum(1) > x[:, half:].sum(1)).astype(float)
    return np.stack([hit, 1 - hit], 1)


def _swapped(spark, d, per_channel):
    from ..operators import baselines

    s = user_series(spark, d)
    near = _ts_near(spark, d, "dtw_dependent", 3)
    out = baselines.segment_swap(near, s, s, busy_first, 0, 3, 6, per_channel)
    return out.select("query_id", "cand_rank", F.round(F.aggregate(F.flatten("value"), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def _swap_sql(per_channel: bool) -> str:
    """Parts in the order of their gaps; running sums of what a swap changes tell when the class flips."""
    part = "ch, seg" if per_channel else "seg"
    return f"""WITH {_SERIES}, {_TS_DEPENDENT}, {_ranked("dd", 3)}, sg AS (SELECT unnest(range(0, 6)) AS seg, days FROM fr),
p AS (SELECT n.query_id, n.rank, q.ch, seg, q.n AS a, c.n AS b, dense_rank() OVER (ORDER BY q.ch) - 1 AS chn FROM n JOIN gr q ON q.id = n.query_id
 JOIN gr c ON c.id = n.train_id AND c.ch = q.ch AND c.t = q.t
 JOIN sg ON q.t >= floor(seg * days / 6) AND q.t < floor((seg + 1) * days / 6)),
g AS (SELECT query_id, rank, {part}, {"any_value(chn) * 6 + seg" if per_channel else "seg"} AS i, round(avg(abs(a - b)), 9) AS gap,
 sum(b - a) FILTER (chn = 0) AS first, sum(b - a) AS change FROM p GROUP BY query_id, rank, {part}),
s AS (SELECT query_id, rank, sum(a) FILTER (chn = 0) AS first, sum(a) AS total, max(chn) + 1 AS channels FROM p GROUP BY ALL),
w AS (SELECT g.query_id, g.rank, row_number() OVER o AS step, s.first + coalesce(sum(g.first) OVER o, 0) AS first, s.total + sum(g.change) OVER o
 AS total, channels FROM g JOIN s ON s.query_id = g.query_id AND s.rank = g.rank WINDOW o AS (PARTITION BY g.query_id, g.rank ORDER BY gap DESC,
 i DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT query_id, rank, arg_min(total, step) AS total FROM w WHERE first >= total / channels GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS cand_rank, round(total, 6) AS total FROM h"""


@_query(_swap_sql(False))
def segment_swap_windows(spark, d):
    """Native guide."""
    return _swapped(spark, d, False)


@_query(_swap_sql(True))
def segment_swap_channels(spark, d):
    """CoMTE."""
    return _swapped(spark, d, True)


_SUM = "list_sum({v}[1:32]) - list_sum({v}[33:64])"


@_query(f"""WITH {_E}, q AS (SELECT * FROM e WHERE label <> {TARGET}), ref AS (SELECT row_number() OVER (ORDER BY vec_id % 64, vec_id) - 1 AS number,
 v AS r FROM e WHERE label = {TARGET}),
dr AS (SELECT vec_id AS id, v, s, r FROM (SELECT *, unnest(range(0, 20)) AS s FROM q) JOIN ref
 ON number = ('0x' || substr(md5('42:' || vec_id || ':' || s), 1, 8))::BIGINT % (SELECT count(*) FROM ref)),
x AS (SELECT id, s, v, r, unnest(range(0, 64)) AS dim FROM dr),
w AS (SELECT id, s, v, r, dim, row_number() OVER o AS step, {_SUM.format(v="v")} + sum(CASE WHEN dim < 32 THEN 1 ELSE -1 END * (r[dim + 1] - v[dim
 + 1])) OVER o AS margin, list_sum(v) + sum(r[dim + 1] - v[dim + 1]) OVER o AS total, max((dim = 6)::INT) OVER o AS seventh FROM x
 WINDOW o AS (PARTITION BY id, s ORDER BY md5('42:' || id || ':' || s || ':' || dim) ROWS UNBOUNDED PRECEDING)),
h AS (SELECT id, total, CASE WHEN seventh = 1 THEN r[7] ELSE v[7] END AS seven, row_number() OVER (PARTITION BY id ORDER BY step, s) AS cand_rank
 FROM w WHERE margin > 0)
SELECT id AS query_id, cand_rank::INT AS cand_rank, round(total, 6) AS value_sum, round(seven, 6) AS value_7 FROM h WHERE cand_rank <= 3""")
def random_copy(spark, d):
    """Copies that take over random dimensions of target rows."""
    from ..operators import baselines

    e = embeddings(spark, d)
    out = baselines.random_copy(e.where(F.col("label") != TARGET), e.where(F.col("label") == TARGET), heavy_first, 0, 3, 20)
    return _digest(out, "query_id", "cand_rank")


@_query(f"""WITH {_E}, lim AS (SELECT list(w ORDER BY dim) AS w FROM (SELECT dim, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS w
 FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e WHERE label = {TARGET}) GROUP BY 1)),
nn AS (SELECT * FROM (SELECT q.vec_id AS id, q.v, c.v AS r, row_number() OVER (PARTITION BY q.vec_id
 ORDER BY round(list_sum(list_transform(list_zip(q.v, c.v, lim.w), lambda z: abs(z[2] - z[1]) / z[3])), 9), c.vec_id) AS rank FROM e q JOIN e c
 ON q.label <> {TARGET} AND c.label = {TARGET} CROSS JOIN lim) WHERE rank = 1),
x AS (SELECT id, v, r, unnest(range(0, 64)) AS dim FROM nn), c AS (SELECT *, CASE WHEN dim < 32 THEN 1 ELSE -1 END * (r[dim + 1] - v[dim + 1]) AS gain
 FROM x WHERE r[dim + 1] <> v[dim + 1]),
w AS (SELECT *, {_SUM.format(v="v")} + coalesce(sum(gain) OVER (PARTITION BY id ORDER BY dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 AS margin, max(gain) OVER (PARTITION BY id ORDER BY dim ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS most FROM c),
f AS (SELECT id, min(dim) AS upto, arg_min(margin, dim) AS margin FROM w WHERE margin + most > 0 GROUP BY 1),
g AS (SELECT f.id, upto, min(dim) AS pick FROM f JOIN c ON c.id = f.id AND c.dim >= upto AND f.margin + gain > 0 GROUP BY ALL),
o AS (SELECT g.id, list_transform(range(1, 65), lambda i: CASE WHEN i - 1 < upto OR i - 1 = pick THEN r[i] ELSE v[i] END) AS z FROM g JOIN nn
 ON nn.id = g.id)
SELECT id AS query_id, 1::INT AS cand_rank, round(list_sum(z), 6) AS value_sum, round(z[7], 6) AS value_7 FROM o""")
def nearest_instance(spark, d):
    """NICE over heterogeneous distances; here all features are numbers."""
    import numpy as np

    from ..operators import baselines

    e = embeddings(spark, d)
    target = e.where(F.col("label") == TARGET)
    limits = target.select(F.posexplode("value").alias("dim", "x")).groupBy("dim").agg(
        F.min("x").alias("low"), F.max("x").alias("high")
    ).orderBy("dim").collect()  # one row per dimension
    f = baselines.heom_kernel(np.array([r.low for r in limits]), np.array([r.high for r in limits]), np.zeros(len(limits), bool))
    near = knn(e.where(F.col("label") != TARGET), target, 1, f, digits=9)
    return _digest(baselines.nearest_instance(near, e, e, heavy_first, 0), "query_id", "cand_rank")


_NOISE = "('0x' || substr(md5('42:' || id || ':' || k || ':' || i || ':{n}'), 1, 8))::BIGINT"
_ADAM = """list_reduce(list_transform(range(1, 101), lambda t: [t::DOUBLE]), lambda s, e: {step}, list_concat(x0, list_transform(range(0, 128), lambda i: 0.0::DOUBLE)))"""
_SIDE = "CASE WHEN i <= 32 THEN 1 ELSE -1 END"
#: Of the state's 192 numbers the first 64 are the point, then come the two moments; g is the gradient.
_GRADIENT = f"({_SIDE}) * -2 / (1 + exp(2 * ({_SUM.format(v='s')}))) + 0.2 * (s[i] - v[i]) / 64"
_MOVED = f"list_transform(range(1, 65), lambda i: [0.9 * s[64 + i] + 0.1 * ({_GRADIENT}), 0.999 * s[128 + i] + 0.001 * ({_GRADIENT}) * ({_GRADIENT})])"
_ADAM_STEP = f"""list_concat(
 list_transform(list_zip({_MOVED}, s[1:64]), lambda z: z[2] - 0.05 * (z[1][1] / (1 - power(0.9, e[1]))) / (sqrt(z[1][2] / (1 - power(0.999, e[1])))
 + 1e-8)),
 list_transform({_MOVED}, lambda z: z[1]), list_transform({_MOVED}, lambda z: z[2]))"""


@_query(f"""WITH {_E}, q AS (SELECT vec_id AS id, v, unnest(range(0, 2)) AS k FROM e WHERE label <> {TARGET}),
n AS (SELECT id, v, k, list_transform(range(0, 64), lambda i: v[i + 1] + 0.01 * (k + 1) * sqrt(-2 * ln(({_NOISE.format(n=0)} + 0.5) / 4294967296))
 * cos(2 * pi() * (({_NOISE.format(n=1)} + 0.5) / 4294967296))) AS x0 FROM q),
r AS (SELECT id, k, {_ADAM.format(step=_ADAM_STEP)} AS s FROM n)
SELECT id AS query_id, (row_number() OVER (PARTITION BY id ORDER BY k))::INT AS cand_rank, round(list_sum(s[1:64]), 6) AS value_sum, round(s[7], 6)
 AS value_7 FROM r WHERE {_SUM.format(v="s")} >= 0""")
def gradient_restarts(spark, d):
    """Two noisy restarts against a fixed linear model."""
    import numpy as np

    from ..operators import baselines

    w = np.stack([np.where(np.arange(64) < 32, 1.0, -1.0), np.where(np.arange(64) < 32, -1.0, 1.0)], 1)
    return _digest(
        baselines.gradient_logistic(embeddings(spark, d).where(F.col("label") != TARGET), w, np.zeros(2), 0, 2, 100), "query_id",
        "cand_rank"
    )


# ---------------------------------------------------------------- runs


@_query("""SELECT a || '/' || b || '/' || c AS combo FROM (SELECT DISTINCT o_orderpriority AS a FROM orders), (SELECT DISTINCT o_orderstatus AS b
 FROM orders), (SELECT DISTINCT l_returnflag AS c FROM lineitem)""")
def config_grid(spark, d):
    """The grid of the axes' values that the tables hold: priorities, states and return flags."""
    from . import sweep

    axis = lambda name, c: sorted(r[0] for r in table(spark, d, name).select(c).where(F.col(c).isNotNull()).distinct().collect())
    axes = {"tab": axis("orders", "o_orderpriority"), "ts": axis("orders", "o_orderstatus"), "text": axis("lineitem", "l_returnflag"), "image": []}
    return spark.createDataFrame([(f"{r['tab']}/{r['ts']}/{r['text']}",) for r in sweep.grid(axes)], "combo string")


@_query("SELECT o_orderkey AS combo_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_runs(spark, d):
    """Orders taken for planned configurations, those with a returned line for finished ones."""
    from ..sources import tables

    done = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("combo_id"), F.when(F.col("l_returnflag") == "R", "ok").otherwise("failed").alias("status")
    )
    return tables.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("combo_id")), done)


@_query("""SELECT c_mktsegment AS segment, count(*) AS expected, count(o) AS done, round(100 * count(o) / count(*), 1) AS percent FROM customer LEFT
 JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey GROUP BY 1""")
def completion_report(spark, d):
    from ..sources import tables

    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"))
    return tables.completion(expected, table(spark, d, "orders").select(F.col("o_custkey").alias("cell")), ["cell"], ["segment"])


@_query("""SELECT o_custkey AS dataset, o_orderkey AS run_id FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def latest_runs(spark, d):
    from ..sources import tables

    return tables.latest_runs(table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("run_id")))


@_query("""WITH m AS (SELECT o_orderstatus AS strategy, o_orderpriority AS model, round(avg(o_totalprice::DOUBLE), 6) AS macro_f1 FROM orders
 GROUP BY ALL)
SELECT strategy, model, macro_f1 FROM m QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY macro_f1 DESC, model) = 1""")
def best_model(spark, d):
    m = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("strategy"), F.col("o_orderpriority").alias("model")
    ).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 6).alias("macro_f1"))
    return analytics.best_model(m)


@_query("""SELECT event_id, concat_ws('/', nullif(event_type, 'click'), CASE WHEN user_id % 2 = 0 THEN 'even' END) AS parts, CASE WHEN concat_ws('/',
 nullif(event_type, 'click'), CASE WHEN user_id % 2 = 0 THEN 'even' END) = '' THEN event_type ELSE concat_ws('/', nullif(event_type, 'click'), CASE
 WHEN user_id % 2 = 0 THEN 'even' END) END AS label FROM events""")
def config_label(spark, d):
    e = table(spark, d, "events").withColumn(
        "a", F.nullif(F.col("event_type"), F.lit("click"))
    ).withColumn("b", F.when(F.col("user_id") % 2 == 0, "even"))
    return e.select("event_id", F.concat_ws("/", "a", "b").alias("parts"), analytics.config_label(["a", "b"], "event_type").alias("label"))


def embedding_dataset(spark, d):
    """The embeddings as a dataset: every row is a training sample, and a test sample of the other classes."""
    from ..sources.dataset import Dataset

    e = embeddings(spark, d)
    both = lambda df: df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test")))
    part = lambda a, n: both(embeddings(spark, d, a, n).select("sample_id", "value"))
    return Dataset(
        both(e.select("sample_id", "label", F.col("label").alias("pred"))), tabular={"low": part(1, 32), "high": part(33, 32)},
        images={"picture": part(1, 64)}, primary_tabular="low"
    )


@_query(f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 20, "a")}, {_knn_cte("nb", "euclidean", 20, "b")}, {_knn_cte("ni", "cosine", 3)},
j AS (SELECT na.query_id, na.train_id, na.distance + nb.distance AS distance FROM na JOIN nb USING (query_id, train_id)), r AS (SELECT *, row_number()
 OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM j)
SELECT 'low' AS generator, rank AS cand_rank, count(*) AS n, sum(train_id)::BIGINT AS ids FROM na WHERE rank <= 3 GROUP BY ALL UNION ALL
 SELECT 'picture', rank, count(*), sum(train_id)::BIGINT FROM ni GROUP BY ALL
UNION ALL SELECT 'consensus', rank::INT, count(*), sum(train_id)::BIGINT FROM r WHERE rank <= 3 GROUP BY ALL UNION ALL SELECT 'synthesis', na.rank,
 count(*), sum(na.train_id)::BIGINT FROM na WHERE na.rank <= 3 GROUP BY ALL""")
def library_generators(spark, d):
    """Four generators over one dataset, the searches of the tabular branches shared."""
    from . import generators as g

    ds = embedding_dataset(spark, d)
    low, high = g.TabularNN("low", k=3), g.TabularNN("high", k=3)
    lib = g.CounterfactualLibrary(
        {"low": low, "picture": g.ImageNN(k=3), "consensus": g.MCR([low, high], 3, 20), "synthesis": g.MPS([low, high], 3, 20)}
    )
    queries = ds.part(ds.samples, "test").where(F.col("label") != TARGET)
    return lib.run(ds, queries, TARGET).groupBy("generator", "cand_rank").agg(F.count("*").alias("n"), F.sum("anchor_id").alias("ids"))


@_query(f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 40, "a")}, {_knn_cte("nb", "euclidean", 40, "b")}, {_knn_cte("np", "manhattan", 40, "a")},
j AS (SELECT na.query_id, na.train_id, na.distance + nb.distance AS distance FROM na JOIN nb USING (query_id, train_id) WHERE na.rank <= 5
 AND nb.rank <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM j)
SELECT 'consensus' AS generator, query_id, rank::INT AS cand_rank, train_id AS anchor_id FROM r WHERE rank <= 3 UNION ALL SELECT 'low', query_id,
 rank, train_id FROM na WHERE rank <= 40 UNION ALL SELECT 'high', query_id, rank, train_id FROM nb
UNION ALL SELECT 'city', query_id, rank, train_id FROM np WHERE rank <= 2""")
def library_mixed_pools(spark, d):
    """A consensus of small pools beside generators that ask for many more neighbours in the same spaces."""
    from . import generators as g

    ds = embedding_dataset(spark, d)
    lib = g.CounterfactualLibrary(
        {
            "consensus": g.MCR([g.TabularNN("low", k=5), g.TabularNN("high", k=5)], 3, 5), "low": g.TabularNN("low", k=40),
            "high": g.TabularNN("high", k=40), "city": g.TabularNN("low", k=2, distance="manhattan")
        }
    )
    queries = ds.part(ds.samples, "test").where(F.col("label") != TARGET)
    return lib.run(ds, queries, TARGET).select("generator", "query_id", "cand_rank", "anchor_id")


def mixed_dataset(spark, d):
    """The embeddings as a dataset of all four kinds; the text tells the signs of eight dimensions. Also the text's vectors."""
    from ..sources.dataset import Dataset

    e = embeddings(spark, d)
    both = lambda df: df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test")))
    part = lambda a, n: both(embeddings(spark, d, a, n).select("sample_id", "value"))
    waves = part(17, 16).withColumn("value", F.array(F.slice("value", 1, 8), F.slice("value", 9, 8)))
    words = part(33, 8).select(
        "split", "sample_id", F.array_join(F.transform("value", lambda x: F.when(x > 0, "up").otherwise("down")), " ").alias("text")
    )
    ds = Dataset(
        both(e.select("sample_id", "label", F.col("label").alias("pred"))), tabular={"low": part(1, 16)}, series={"waves": waves},
        texts={"words": words}, images={"picture": part(49, 16)}
    )
    return ds, {"words": part(33, 16)}


def _percentile_sql(name: str, dims: str, candidate: str) -> str:
    """Percentile ranks of outlier factors against the target class, for candidates (``id``, ``v``); rows (id, p)."""
    gap = "sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    k = f"(SELECT greatest(2, least(20, count(*) - 1)) FROM ref_{name})"
    near = lambda out, q, where: f"{out}_{name} AS (SELECT * FROM (SELECT q.id, c.id AS nb, {gap} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {gap}, c.id) AS r FROM {q} q JOIN ref_{name} c ON {where}) WHERE r <= {k})"
    return f"""ref_{name} AS (SELECT 'r' || vec_id AS id, {dims} AS v FROM e WHERE label = {TARGET}), all_{name} AS (SELECT * FROM ref_{name}
 UNION ALL {candidate}),
{near("own", f"ref_{name}", "q.id <> c.id")}, kd_{name} AS (SELECT id, max(d) AS kd FROM own_{name} GROUP BY 1),
lr_{name} AS (SELECT o.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM own_{name} o JOIN kd_{name} k ON k.id = nb GROUP BY 1),
 {near("near", f"all_{name}", "true")},
lof_{name} AS (SELECT n.id, round(avg(lrd) * (avg(greatest(d, kd)) + 1e-10), 9) AS lof FROM near_{name} n JOIN kd_{name} k ON k.id = nb
 JOIN lr_{name} l ON l.id = nb GROUP BY 1),
p_{name} AS (SELECT x.id, avg((y.lof <= x.lof)::INT) AS p FROM lof_{name} x, lof_{name} y WHERE x.id NOT LIKE 'r%' AND y.id LIKE 'r%' GROUP BY 1)"""


_MAE = "list_avg(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"
_CHANGED = "list_avg(list_transform(list_zip({a}, {b}), lambda z: (z[1] <> z[2])::INT))"
_SIGNS = "array_to_string(list_transform({v}[33:40], lambda x: CASE WHEN x > 0 THEN 'u' ELSE 'd' END), '')"


@_query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding[1:16], lambda x: x::DOUBLE)
 AS low FROM embeddings), {_knn_cte("n", "euclidean", 3, "low")},
i AS (SELECT query_id, rank AS cand_rank, train_id, max(rank) OVER (PARTITION BY query_id) AS k FROM n),
x AS (SELECT i.query_id, cand_rank, unnest(e.v[1:32]) AS x, unnest(range(1, 33)) AS dim FROM i JOIN n ON n.query_id = i.query_id AND n.rank <= least(2
 * cand_rank - 1, k) JOIN e ON vec_id = n.train_id),
m AS (SELECT query_id, cand_rank, list(m ORDER BY dim) AS m FROM (SELECT query_id, cand_rank, dim, median(x) AS m FROM x GROUP BY ALL) GROUP BY ALL),
c AS (SELECT 'c' || i.query_id || ':' || i.cand_rank AS id, i.query_id, i.cand_rank, q.v AS q, m.m, a.v AS a FROM i JOIN m USING (query_id, cand_rank)
 JOIN e q ON q.vec_id = i.query_id JOIN e a ON a.vec_id = i.train_id),
{_percentile_sql("tab", "v[1:16]", "SELECT id, m[1:16] FROM c")}, {_percentile_sql("ser", "v[17:32]", "SELECT id, m[17:32] FROM c")},
{_percentile_sql("txt", "v[33:48]", "SELECT id, a[33:48] FROM c")}, {_percentile_sql("img", "v[49:64]", "SELECT id, a[49:64] FROM c")}
SELECT 'low' AS generator, query_id, cand_rank, 0.0::DOUBLE AS outcome,
round(({_MAE.format(a="q[1:16]", b="m[1:16]")} + {_MAE.format(a="q[17:32]", b="m[17:32]")} + least(greatest((1 - list_inner_product(q[33:48],
 a[33:48])) / 2, 0), 1) + least(greatest((1 - list_cosine_similarity(q[49:64], a[49:64])) / 2, 0), 1)) / 4, 6) AS proximity,
round(({_CHANGED.format(a="q[1:16]", b="m[1:16]")} + {_CHANGED.format(a="q[17:32]", b="m[17:32]")} + levenshtein({_SIGNS.format(v="q")},
 {_SIGNS.format(v="a")}) / 8 + {_CHANGED.format(a="q[49:64]", b="a[49:64]")}) / 4, 6) AS sparsity,
round((t.p + s.p + x.p + g.p) / 4, 6) AS plausibility FROM c JOIN p_tab t USING (id) JOIN p_ser s USING (id) JOIN p_txt x USING (id) JOIN p_img g
 USING (id)""")
def objectives_four_modalities(spark, d):
    """Candidates scored over a tabular, a series, a text and an image branch, plausibility included."""
    from . import generators as g, sweep

    ds, text_vectors = mixed_dataset(spark, d)
    queries = ds.part(ds.samples, "test").where(F.col("label") != TARGET)
    found = g.CounterfactualLibrary({"low": g.TabularNN("low", k=3)}).run(ds, queries, TARGET)
    return _rounded(sweep.score(ds, found, TARGET, vectors=text_vectors), "proximity", "sparsity", "plausibility")


# ---------------------------------------------------------------- more of the score tables


@_query(f"WITH {_SWEEP} SELECT generator, count(*) AS n_candidates FROM s GROUP BY 1")
def candidate_counts(spark, d):
    return analytics.candidate_counts(sweep_scores(spark, d))


@_query(f"""WITH {_SWEEP}, o AS (SELECT o_orderpriority AS generator, o_orderstatus AS config, o_orderkey AS run, o_totalprice::DOUBLE AS v
 FROM orders)
SELECT generator, {", ".join(f"round(arg_max(v, run) FILTER (config = '{c}'), 2) AS {c.lower()}" for c in "FOP")} FROM o GROUP BY 1""")
def heatmap_last_cells(spark, d):
    """The last run's value in each cell of generator by configuration."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("generator"),
        F.col("o_orderstatus").alias("config"),
        F.col("o_orderkey").alias("run"),
        F.col("o_totalprice").cast("double").alias("v"),
    )
    out = analytics.last_per_cell(o, "generator", "config", ["F", "O", "P"], "v", "run")
    return out.select("generator", *[F.round(c, 2).alias(c.lower()) for c in "FOP"])


@_query(f"WITH {_SWEEP} SELECT config, generator, {_MEANS} FROM s GROUP BY ALL")
def strategy_stability(spark, d):
    """Means per strategy (here the configuration) and generator."""
    return _rounded(analytics.means(sweep_scores(spark, d), ["config", "generator"]), *analytics.OBJECTIVES)


@_query(f"""WITH {_SWEEP}, m AS (SELECT config, generator, {", ".join(f"avg({c}) AS {c}" for c in analytics.OBJECTIVES)} FROM s GROUP BY ALL)
SELECT generator, {_MEANS} FROM m GROUP BY 1""")
def grand_means(spark, d):
    """Each generator's mean over strategies of its means."""
    return _rounded(analytics.mean_of_means(sweep_scores(spark, d), ["config", "generator"], ["generator"]), *analytics.OBJECTIVES)


@_query(f"""WITH {_SWEEP}, k AS (SELECT k, config, generator, {", ".join(f"avg({c}) AS {c}" for c in analytics.OBJECTIVES)} FROM s
 JOIN (VALUES (1), (5), (20)) v(k) ON cand_rank <= k GROUP BY ALL) SELECT k, generator, {_MEANS} FROM k GROUP BY ALL""")
def k_curve_over_strategies(spark, d):
    """The k curve of each strategy, then the mean over strategies."""
    per = analytics.k_curve(sweep_scores(spark, d), [1, 5, 20], ("config", "generator"))
    return _rounded(analytics.means(per, ["k", "generator"]), *analytics.OBJECTIVES)


@_query("""WITH s AS (SELECT doc_id % 3 AS fold, quality AS y, floor(n_chars / 100) AS x FROM labels JOIN documents USING (doc_id)),
r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY x) + (count(*) OVER (PARTITION BY fold, x) - 1) / 2.0 AS r FROM s),
a AS (SELECT fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)
 * count(*) FILTER (y = 0)) AS a FROM r GROUP BY 1)
SELECT round(avg(a), 6) AS auroc FROM a""")
def auroc_over_folds(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(
        (F.col("doc_id") % 3).alias("fold"), F.col("quality").alias("label"), F.floor(F.col("n_chars") / 100).alias("score")
    )
    return analytics.auroc(rows, ["fold"]).agg(F.round(F.avg("auroc"), 6).alias("auroc"))


@_query("""WITH s AS (SELECT label AS y, list_transform(embedding[1:10], lambda e: e::DOUBLE) AS x FROM embeddings),
f AS (SELECT c, (y = c)::INT AS y, x[c + 1] AS x FROM s, (SELECT unnest(range(0, 10)) AS c) v),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS r FROM f),
a AS (SELECT c, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1)
 * count(*) FILTER (y = 0)) AS a FROM r GROUP BY 1)
SELECT round(avg(a), 6) AS auroc FROM a""")
def auroc_one_versus_rest(spark, d):
    e = embeddings(spark, d, 1, 10).select("label", F.col("value").alias("scores"))
    return _rounded(analytics.auroc_ovr(e, list(range(10))), "auroc")


# ---------------------------------------------------------------- more candidates, encoders and preparation


_CONSENSUS_MEDIANS = f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 20, "a")}, {_knn_cte("nb", "manhattan", 20, "b")},
j AS (SELECT na.query_id, na.train_id, na.distance + nb.distance AS distance FROM na JOIN nb USING (query_id, train_id)),
n AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id))::INT AS rank FROM j) WHERE rank <= 5)"""


@_query(_MEDIAN_SQL.format(e="@", n="@", prefix="least(2 * cand_rank - 1, k)", anchor="cand_rank").replace("WITH @, @", _CONSENSUS_MEDIANS))
def consensus_medians(spark, d):
    """Prefix medians of the rows that both halves list."""
    near = combine.consensus(_halves(spark, d, 20), 5)
    out = combine.progressive_medians(near, embeddings(spark, d))
    return _digest(out, "query_id", "cand_rank", "n_used", "anchor_id")


@_query(f"""WITH {_HALVES}, {_knn_cte("na", "euclidean", 2, "a")}, {_knn_cte("nb", "manhattan", 2, "b")}
SELECT 'a' AS space, query_id, train_id, rank FROM na UNION ALL SELECT 'b', query_id, train_id, rank FROM nb""")
def union_of_spaces(spark, d):
    return combine.union_spaces(_halves(spark, d, 2)).select("space", "query_id", "train_id", "rank")


@_query(f"""WITH {_E}, {_knn_cte("n", "euclidean", 2)} SELECT query_id, rank AS cand_rank, train_id AS anchor_id, text FROM n
 LEFT JOIN documents ON doc_id = train_id""")
def anchor_texts(spark, d):
    """Candidates with their anchor's text, here the document of the same number."""
    near = _near(spark, d, 2, "euclidean").select("query_id", F.col("rank").alias("cand_rank"), F.col("train_id").alias("anchor_id"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return combine.with_anchor_texts(near, texts).select("query_id", "cand_rank", "anchor_id", "text")


@_query("""WITH t AS (SELECT vec_id, list_transform(range(0, 4), lambda i: list_transform(embedding[16 * i + 1:16 * i + 16], lambda x: x::DOUBLE))
 AS t,
 list_transform(range(0, 4), lambda i: CASE WHEN i = 0 OR embedding[16 * i + 1] > 0 THEN 1.0 ELSE 0.0 END) AS m FROM embeddings),
p AS (SELECT vec_id, t, list_transform(range(1, 17), lambda d: list_sum(list_transform(range(1, 5), lambda i: t[i][d] * m[i])) / list_sum(m)) AS p
 FROM t)
SELECT vec_id AS sample_id, round(list_sum(p), 6) AS mean_sum, round(p[7], 6) AS mean_7, round(list_sum(t[1]), 6) AS first_sum, round(p[7]
 / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS unit_7 FROM p""")
def pooled_tokens(spark, d):
    """Masked means, first tokens and unit means of token vectors: each embedding as four tokens, those that begin below zero masked."""
    e = embeddings(spark, d)
    tokens = F.array(*[F.slice("value", 16 * i + 1, 16) for i in range(4)])
    mask = F.array(*[F.when(F.get("value", F.lit(16 * i)) > 0, 1.0).otherwise(1.0 if i == 0 else 0.0) for i in range(4)])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    p = e.select(
        "sample_id", encoders.mean_pooled(tokens, mask).alias("p"), encoders.first_pooled(tokens).alias("f"),
        encoders.prefixed_pooled(tokens, mask).alias("u")
    )
    out = p.select(
        "sample_id", total("p").alias("mean_sum"), F.get("p", F.lit(6)).alias("mean_7"), total("f").alias("first_sum"),
        F.get("u", F.lit(6)).alias("unit_7")
    )
    return _rounded(out, "mean_sum", "mean_7", "first_sum", "unit_7")


_TOP_TERMS = f"""WITH {_TFIDF}, top AS (SELECT t FROM c0 GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 50),
tw AS (SELECT id, t, (ln(n) + 1) * idf AS w FROM (SELECT id, t, count(*) AS n FROM c0 GROUP BY ALL) JOIN idf USING (t) WHERE t IN (SELECT t
 FROM top)),
ts AS (SELECT id, sqrt(sum(w * w)) AS s FROM tw GROUP BY 1)"""


@_query(f"{_TOP_TERMS} SELECT id AS sample_id, count(*) AS n_terms, round(max(w / s), 6) AS top_weight FROM tw JOIN ts USING (id) GROUP BY 1")
def tfidf_sublinear(spark, d):
    """The 50 most frequent terms only, with logarithmic term counts."""
    c = _texts(spark, d)[1]
    out = encoders.tfidf_transform(c, encoders.tfidf_fit(c, 50), sublinear=True)
    return out.groupBy("sample_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"))


@_query(f"""WITH {_SERIES}, {_TS_NEAR}, p AS (SELECT n.query_id, n.rank, q.ch, avg(abs(q.n - c.n)) AS gap FROM n JOIN gr q ON q.id = n.query_id
 JOIN gr c ON c.id = n.train_id AND c.ch = q.ch AND c.t = q.t GROUP BY ALL)
SELECT query_id, rank, round(avg(gap), 6) AS proximity, round(avg((gap > 1e-6)::INT), 6) AS sparsity FROM p GROUP BY ALL""")
def baseline_series_objectives(spark, d):
    s = user_series(spark, d)
    n = _ts_near(spark, d, "euclidean", rows=s)
    j = n.join(s.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a")), "query_id")
    j = j.join(s.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b")), "train_id")
    near, sparse = scores.baseline_series(F.col("a"), F.col("b"))
    return _rounded(j.select("query_id", "rank", near.alias("proximity"), sparse.alias("sparsity")), "proximity", "sparsity")


@_query(f"""WITH {_SERIES}, {_TS_NEAR}, h AS (SELECT ch, dense_rank() OVER (ORDER BY ch) AS i FROM (SELECT DISTINCT ch FROM gr)),
p AS (SELECT n.query_id, n.rank, CASE WHEN i <= 2 THEN 'labs' ELSE 'meds' END AS part, q.ch, q.n AS a, c.n AS b FROM n JOIN gr q ON q.id = n.query_id
 JOIN h ON h.ch = q.ch JOIN gr c ON c.id = n.train_id AND c.ch = q.ch AND c.t = q.t),
m AS (SELECT query_id, rank, part, avg((a <> b)::INT) AS s FROM p GROUP BY ALL), x AS (SELECT query_id, rank, avg(abs(a - b)) AS p FROM p
 GROUP BY ALL)
SELECT query_id, rank, round(any_value(p), 6) AS proximity, round(avg(s), 6) AS sparsity FROM m JOIN x USING (query_id, rank) GROUP BY ALL""")
def split_series_objectives(spark, d):
    """Two groups of channels: proximity over all values together, sparsity as the mean of both groups'."""
    s = user_series(spark, d)
    n = _ts_near(spark, d, "euclidean", rows=s)
    part = lambda v, first: F.slice(v, 1, 2) if first else F.slice(v, 3, F.size(v) - 2)
    j = n.join(s.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a")), "query_id")
    j = j.join(s.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b")), "train_id")
    pairs = [(part(F.col("a"), f), part(F.col("b"), f)) for f in (True, False)]
    return _rounded(
        j.select("query_id", "rank", series.split_proximity(pairs).alias("proximity"), series.split_sparsity(pairs).alias("sparsity")),
        "proximity", "sparsity",
    )


@_query(f"""{_PAIRS} SELECT query_id, rank, round(0.3 * a[1] + 0.7 * b[1], 6) AS base, round((2 * (0.3 * a[1] + 0.7 * b[1]) + a[2]) / 3, 6) AS mean_,
 round(2 * (0.3 * a[1] + 0.7 * b[1]) + a[2], 6) AS sum_ FROM p""")
def merged_plausibility(spark, d):
    """Three scores merged by weight, as a mean and as a sum; here components of vectors stand for them."""
    p, at = _pairs(spark, d), lambda c, i: F.get(c, F.lit(i))
    tab, ser, txt = at("a", 0), at("b", 0), at("a", 1)
    merged = lambda **o: scores.merged_plausibility(tab, ser, 0.3, **o)
    out = p.select(
        "query_id", "rank", merged().alias("base"), merged(text=txt, base_weight=2.0).alias("mean_"),
        merged(text=txt, base_weight=2.0, how="weighted_sum").alias("sum_")
    )
    return _rounded(out, "base", "mean_", "sum_")


@_query("""WITH s AS (SELECT c_custkey AS sample_id, concat_ws(',', 'C' || c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN ' S' || c_custkey % 7 END,
 CASE WHEN c_custkey % 3 > 1 THEN 'T' END) AS l,
 CASE WHEN c_custkey % 4 = 0 THEN 'x' WHEN c_custkey % 4 = 1 THEN NULL ELSE (c_custkey % 50) || '-' || (c_custkey % 50 + 10) END AS w FROM customer),
m AS (SELECT median(sample_id % 50 + 5) AS m FROM s WHERE sample_id % 4 > 1 AND sample_id % 5 > 0)
SELECT sample_id, string_split(l, ',')[1] AS country, trim(string_split(l, ',')[2]) AS state, string_split(l, ',')[3] AS city, CASE
 WHEN sample_id % 4 > 1 THEN sample_id % 50 + 5.0 ELSE m END AS salary FROM s, m""")
def location_and_salary(spark, d):
    """Locations cut into their parts; salary ranges' midpoints, missing ones filled with the training rows' median."""
    k = F.col("sample_id")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey")
    c = c.withColumn(
        "l", F.concat_ws(",", F.concat(F.lit("C"), "c_nationkey"), F.when(k % 3 > 0, F.concat(F.lit(" S"), k % 7)), F.when(k % 3 > 1, "T"))
    )
    c = c.withColumn("w", F.when(k % 4 == 0, "x").when(k % 4 > 1, F.concat_ws("-", (k % 50).cast("string"), (k % 50 + 10).cast("string"))))
    out = c.select("sample_id", *preprocess.split_location(F.col("l")), preprocess.salary_midpoint(F.col("w")).alias("salary"))
    return preprocess.fill_median(out, "salary", F.col("sample_id") % 5 > 0)


@_query(f"""WITH {_TEXTS}, {", ".join(f"{x}g AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(w) AS t FROM {x}) GROUP BY ALL)" for x in "qc")},
o AS (SELECT a.id AS q, b.id AS c, sum(least(a.n, b.n)) AS o FROM qg a JOIN cg b USING (t) GROUP BY ALL)
SELECT q.id::BIGINT AS query_id, c.id AS train_id, round(1 - 2 * coalesce(o, 0) / (len(q.w) + len(c.w)), 6) AS distance FROM q JOIN c ON c.id = q.id
 LEFT JOIN o ON o.q = q.id AND o.c = c.id""")
def text_pair_distance(spark, d):
    """Each benchmark text against the assistant's turn of the same number."""
    q, c = _texts(spark, d)
    j = q.select(F.col("sample_id").alias("query_id"), F.col("value").alias("a")).join(
        c.select(F.col("sample_id").alias("train_id"), F.col("value").alias("b")), F.col("query_id") == F.col("train_id")
    )
    return _rounded(j.select("query_id", "train_id", (1 - text.rouge_n(F.col("a"), F.col("b"), 1)).alias("distance")), "distance")
