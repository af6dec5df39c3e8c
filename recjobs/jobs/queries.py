"""Registered queries of the recommendation library, each with its SQL where SQL can express it.

``QUERIES`` maps a name to a function of (spark, directory of tables); ``SQL`` maps the same name to
the statement that gives the same rows in another engine. The first part of a name is the operator's
number in the survey of operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recjobs.functions.columns import rounded
from recjobs.functions.storage import materialize, new_folder
from recjobs.jobs import recommend
from recjobs.operators import allitems, classify, evaluate, factors, features, hybrid, linear, pairs, prep, ranking, similarity
from recjobs.sources import files, tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CTES = {
    "raw": """SELECT o_custkey AS user_id, l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS interaction_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'""",
    "araw": """SELECT o_custkey AS user_id, l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS interaction_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "aratings": "SELECT user_id, item_id, CAST(max(interaction_type) AS DOUBLE) AS rating FROM araw GROUP BY user_id, item_id",
    "ratings": "SELECT user_id, item_id, CAST(max(interaction_type) AS DOUBLE) AS rating FROM raw GROUP BY user_id, item_id",
    "items": "SELECT p_partkey AS item_id, p_name AS title, p_type AS tags, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_size <= 40 AS active FROM part",
    "users": "SELECT c_custkey AS user_id, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "targets": "SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')",
    "popular": """SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM
        (SELECT i.item_id, CAST(count(r.user_id) AS DOUBLE) AS score FROM items i LEFT JOIN ratings r USING (item_id) GROUP BY i.item_id)""",
    # content of items: brand and size (one-hot), words of title and tags (TF-IDF)
    "icounts": """SELECT id, attr, token, CAST(count(*) AS DOUBLE) AS weight FROM (
        SELECT item_id AS id, attr, unnest(regexp_extract_all(lower(v), '[a-z0-9_]+')) AS token FROM (
          SELECT item_id, unnest(['title', 'tags', 'brand', 'size']) AS attr, unnest([title, tags, brand, CAST(size AS VARCHAR)]) AS v FROM items)) GROUP BY 1, 2, 3""",
    "icontent": """SELECT * FROM icounts WHERE attr IN ('brand', 'size') UNION ALL SELECT id, attr, token, v / sqrt(sum(v * v) OVER (PARTITION BY id, attr)) AS weight FROM (
        SELECT id, attr, token, weight * (ln((1 + (SELECT count(*) FROM items)) / CAST(1 + count(*) OVER (PARTITION BY attr, token) AS DOUBLE)) + 1) AS v FROM icounts WHERE attr IN ('title', 'tags'))""",
    "iunit": "SELECT id, attr, token, weight / (sqrt(sum(weight * weight) OVER (PARTITION BY id)) + 1e-6) AS w FROM icontent",
    "idots": """SELECT x.id AS i, y.id AS j, sum(x.w * y.w) AS dot, count(*) AS co FROM iunit x JOIN iunit y USING (attr, token)
        WHERE x.id <> y.id GROUP BY x.id, y.id""",
    "isims": "SELECT i, j, floor(dot * (co / (co + CAST(2 AS DOUBLE))) * 1e6 + 5e-1) / 1e6 AS sim FROM idots",
    "inear": "SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM isims WHERE sim > 0) WHERE rank <= 20",
    "norms": "SELECT item_id, sqrt(sum(rating * rating)) AS norm FROM ratings GROUP BY item_id",
    "cdots": """SELECT d.i, d.j, d.dot / ((a.norm + 1e-6) * (b.norm + 1e-6)) AS dot, d.co FROM (
        SELECT x.item_id AS i, y.item_id AS j, sum(x.rating * y.rating) AS dot, count(*) AS co FROM ratings x JOIN ratings y USING (user_id)
        WHERE x.item_id <> y.item_id GROUP BY 1, 2) d JOIN norms a ON a.item_id = d.i JOIN norms b ON b.item_id = d.j""",
    "csims": "SELECT i, j, floor(dot * (co / (co + CAST(10 AS DOUBLE))) * 1e6 + 5e-1) / 1e6 AS sim FROM cdots",
    "cnear": "SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM csims WHERE sim > 0) WHERE rank <= 50",
    "agram": "SELECT x.item_id AS i, y.item_id AS j, sum(x.rating * y.rating) AS g FROM aratings x JOIN aratings y USING (user_id) GROUP BY 1, 2",
    "mine": "SELECT r.* FROM ratings r SEMI JOIN targets USING (user_id)",
    "scores": """SELECT m.user_id, w.j AS item_id, floor(sum(m.rating * w.sim) * 1e6 + 5e-1) / 1e6 AS score FROM mine m JOIN cnear w ON m.item_id = w.i
        JOIN items i ON w.j = i.item_id WHERE i.active GROUP BY 1, 2""",
    "unseen": "SELECT s.* FROM scores s ANTI JOIN mine m ON s.user_id = m.user_id AND s.item_id = m.item_id",
    "lists": """SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
        FROM unseen WHERE score > 0) WHERE rank <= 5""",
    "head": "SELECT item_id, row_number() OVER (ORDER BY p.rank) AS rank FROM popular p JOIN items i USING (item_id) WHERE i.active QUALIFY row_number() OVER (ORDER BY p.rank) <= 5",
    "recs": """SELECT user_id, item_id, score, rank FROM lists UNION ALL SELECT t.user_id, h.item_id, CAST(0 AS DOUBLE), h.rank
        FROM (SELECT * FROM targets t ANTI JOIN lists l USING (user_id)) t CROSS JOIN head h""",
    "sampled": "SELECT * FROM ratings SEMI JOIN (SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings) ORDER BY md5('7:' || user_id), user_id LIMIT 200) USING (user_id)",
    "shown": """SELECT *, n > 1 AND k > floor(CAST(0.75 AS DOUBLE) * n) AS hidden FROM (SELECT user_id, item_id, rating, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY md5('3:' || user_id || ':' || item_id), item_id) AS k FROM ratings)""",
    "effects": """SELECT *, d2 - avg(d2) OVER (PARTITION BY user_id) AS residual, avg(d2) OVER (PARTITION BY user_id) AS user_bias FROM (
        SELECT *, d - avg(d) OVER (PARTITION BY item_id) AS d2, avg(d) OVER (PARTITION BY item_id) AS item_bias FROM (
          SELECT *, rating - avg(rating) OVER () AS d, avg(rating) OVER () AS mu FROM ratings))""",
    "aeffects": """SELECT *, d2 - avg(d2) OVER (PARTITION BY user_id) AS residual, avg(d2) OVER (PARTITION BY user_id) AS user_bias FROM (
        SELECT *, d - avg(d) OVER (PARTITION BY item_id) AS d2, avg(d) OVER (PARTITION BY item_id) AS item_bias FROM (
          SELECT *, rating - avg(rating) OVER () AS d, avg(rating) OVER () AS mu FROM aratings))""",
    "predicted": "SELECT doc_id AS id, quality AS label, CAST(length(text) > 1500 AS INT) AS prediction, CASE WHEN length(text) > 1500 THEN 0.75 ELSE 0.5 END AS probability FROM documents JOIN labels USING (doc_id)",
    "ulist": "SELECT DISTINCT user_id FROM ratings",
    "uwords": """SELECT user_id AS id, 'segment' AS attr, unnest(regexp_extract_all(lower(segment), '[a-z0-9_]+')) AS token FROM users
        UNION ALL SELECT user_id, 'location', unnest(regexp_extract_all(nation || '_' || region, '[a-z0-9_]+')) FROM users""",
    "ucounts": "SELECT id, attr, token, CAST(count(*) AS DOUBLE) AS weight FROM uwords GROUP BY 1, 2, 3",
    "ucontent": """SELECT id, attr, token, CASE WHEN attr = 'segment' THEN weight ELSE v / sqrt(sum(v * v) OVER (PARTITION BY id, attr)) END AS weight FROM (
        SELECT *, weight * (ln((1 + (SELECT count(*) FROM users)) / CAST(1 + count(*) OVER (PARTITION BY attr, token) AS DOUBLE)) + 1) AS v FROM ucounts)""",
    "uunit": "SELECT id, attr, token, weight / (sqrt(sum(weight * weight) OVER (PARTITION BY id)) + 1e-6) AS w FROM ucontent",
    "unear": """SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM (
        SELECT x.id AS i, y.id AS j, floor(sum(x.w * y.w) * 1e6 + 5e-1) / 1e6 AS sim FROM uunit x JOIN uunit y USING (attr, token)
        WHERE x.id IN (SELECT user_id FROM targets EXCEPT SELECT user_id FROM ratings) AND y.id IN (SELECT user_id FROM ratings) GROUP BY 1, 2)) WHERE sim > 0 AND rank <= 3""",
    # items that a content job recommends
    "wscores": """SELECT m.user_id, s.j AS item_id, floor(sum(m.rating * s.sim) * 1e6 + 5e-1) / 1e6 AS score FROM mine m JOIN isims s ON m.item_id = s.i
        JOIN items i ON i.item_id = s.j WHERE i.active AND s.sim > 0 GROUP BY 1, 2""",
    "wlists": """SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
        FROM wscores s ANTI JOIN mine m ON s.user_id = m.user_id AND s.item_id = m.item_id WHERE score > 0) WHERE rank <= 5""",
    "wrecs": """SELECT user_id, item_id, score, rank FROM wlists UNION ALL SELECT t.user_id, h.item_id, CAST(0 AS DOUBLE), h.rank
        FROM (SELECT * FROM targets t ANTI JOIN wlists l USING (user_id)) t CROSS JOIN head h""",
    "isample": "SELECT user_id, item_id, rating FROM ratings ORDER BY md5('7:' || user_id || ':' || item_id), user_id, item_id LIMIT 5000",
    "hshown": """SELECT *, n > 1 AND k > floor(CAST(0.75 AS DOUBLE) * n) AS hidden FROM (SELECT user_id, item_id, rating, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY md5('3:' || user_id || ':' || item_id), item_id) AS k FROM ratings
        WHERE CAST('0x' || substr(md5('3:' || user_id || ':' || item_id), 1, 8) AS BIGINT) < 2147483648)""",
    "splits": """SELECT user_id, item_id, rating, rep, CAST('0x' || substr(md5('9:' || rep || ':' || user_id || ':' || item_id), 1, 8) AS BIGINT) >= 3221225472 AS hidden
        FROM ratings CROSS JOIN (SELECT unnest([0, 1, 2]) AS rep)""",
    "oneshown": "SELECT *, 0 AS rep FROM shown",
    "onehshown": "SELECT *, 0 AS rep FROM hshown",
    "folds2": "SELECT user_id, ntile(2) OVER (ORDER BY md5('3:' || user_id), user_id) - 1 AS fold FROM ulist",
}
#: Which of the others each needs.
NEEDS = {
    "ratings": "raw", "aratings": "araw", "popular": "items ratings", "icounts": "items", "icontent": "icounts items", "iunit": "icontent", "idots": "iunit", "isims": "idots", "inear": "isims",
    "norms": "ratings", "cdots": "ratings norms", "csims": "cdots", "cnear": "csims", "agram": "aratings", "mine": "ratings targets", "scores": "mine cnear items",
    "unseen": "scores mine", "lists": "unseen", "head": "popular items", "recs": "lists targets head", "sampled": "ratings", "shown": "ratings", "hshown": "ratings", "splits": "ratings",
    "oneshown": "shown", "onehshown": "hshown", "effects": "ratings", "aeffects": "aratings", "ulist": "ratings", "uwords": "users", "ucounts": "uwords", "ucontent": "ucounts users", "uunit": "ucontent",
    "unear": "uunit targets ratings", "wscores": "mine isims items", "wlists": "wscores mine", "wrecs": "wlists targets head", "isample": "ratings", "folds2": "ulist",
}


def _add(name: str, sql: str, needs: str) -> None:
    CTES[name], NEEDS[name] = sql, needs


def _average_precisions(prefix: str, shown: str, listed: str, keys: str, needs: str) -> None:
    """``{prefix}aps(keys, user_id, ap)`` of lists and what ``shown`` hides; ``keys`` are columns that both have."""
    on = " AND ".join(f"v.{k} = h.{k}" for k in [*keys.split(", "), "user_id"])
    _add(
        f"{prefix}aps",
        f"""SELECT {", ".join("h." + k for k in keys.split(", "))}, h.user_id, floor(coalesce(v.s / least(h.n, v.m), 0) * 1e6 + 5e-1) / 1e6 AS ap
        FROM (SELECT {keys}, user_id, count(*) AS n FROM {shown} WHERE hidden GROUP BY ALL) h LEFT JOIN (
          SELECT {keys}, user_id, sum(rel * hits / CAST(rank AS DOUBLE)) AS s, count(*) AS m FROM (
            SELECT {", ".join("v." + k for k in keys.split(", "))}, v.user_id, v.rank, CASE WHEN h.item_id IS NULL THEN 0 ELSE 1 END AS rel,
              sum(CASE WHEN h.item_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {", ".join("v." + k for k in keys.split(", "))}, v.user_id ORDER BY v.rank) AS hits
            FROM {listed} v LEFT JOIN (SELECT {keys}, user_id, item_id FROM {shown} WHERE hidden) h ON {on} AND v.item_id = h.item_id) GROUP BY ALL) v ON {on}""",
        needs,
    )


def _popular_lists(prefix: str, shown: str) -> None:
    """``{prefix}recs``: the popular items that users' visible ratings don't hold; users of all ratings
    shown if none is hidden from them."""
    _add(f"{prefix}popular", f"SELECT rep, item_id, row_number() OVER (PARTITION BY rep ORDER BY count(*) DESC, item_id) AS place FROM {shown} JOIN items USING (item_id) WHERE NOT hidden AND active GROUP BY rep, item_id", f"{shown} items")
    _add(
        f"{prefix}recs",
        f"""SELECT rep, user_id, item_id, rank FROM (SELECT u.rep, u.user_id, p.item_id, row_number() OVER (PARTITION BY u.rep, u.user_id ORDER BY p.place) AS rank
        FROM (SELECT DISTINCT rep, user_id FROM {shown} WHERE NOT hidden) u
        JOIN (SELECT * FROM {prefix}popular WHERE place <= 5 + (SELECT max(c) FROM (SELECT count(*) AS c FROM {shown} WHERE NOT hidden GROUP BY rep, user_id))) p ON p.rep = u.rep
        ANTI JOIN (SELECT rep, user_id, item_id FROM {shown} WHERE NOT hidden) s ON s.rep = u.rep AND s.user_id = u.user_id AND s.item_id = p.item_id) WHERE rank <= 5""",
        f"{prefix}popular {shown}",
    )
    _average_precisions(prefix, shown, f"{prefix}recs", "rep", f"{prefix}recs {shown}")


_popular_lists("v", "oneshown")
_add("aps", "SELECT user_id, ap FROM vaps", "vaps")
_popular_lists("h", "onehshown")
_popular_lists("r", "splits")


def _grid(prefix: str, rating: str, shrinks: str, ks: str) -> None:
    """``{prefix}maps(fold, shrink, k, map)``: item neighbours cross-validated over two folds."""
    p = prefix
    _add(f"{p}train", f"SELECT f.fold, r.user_id, r.item_id, {rating} AS rating FROM ratings r JOIN folds2 u USING (user_id) JOIN (SELECT unnest([0, 1]) AS fold) f ON u.fold <> f.fold", "ratings folds2")
    _add(f"{p}norms", f"SELECT fold, item_id, sqrt(sum(rating * rating)) AS norm FROM {p}train GROUP BY 1, 2", f"{p}train")
    _add(
        f"{p}dots",
        f"""SELECT d.fold, d.i, d.j, d.dot / ((a.norm + 1e-6) * (b.norm + 1e-6)) AS dot, d.co FROM (
        SELECT x.fold, x.item_id AS i, y.item_id AS j, sum(x.rating * y.rating) AS dot, count(*) AS co FROM {p}train x JOIN {p}train y USING (fold, user_id) WHERE x.item_id <> y.item_id GROUP BY 1, 2, 3) d
        JOIN {p}norms a ON a.fold = d.fold AND a.item_id = d.i JOIN {p}norms b ON b.fold = d.fold AND b.item_id = d.j""",
        f"{p}train {p}norms",
    )
    _add(
        f"{p}near",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, shrink, i ORDER BY sim DESC, j) AS rank FROM (
        SELECT fold, shrink, i, j, floor(CASE WHEN shrink > 0 THEN dot * (co / (co + CAST(shrink AS DOUBLE))) ELSE dot END * 1e6 + 5e-1) / 1e6 AS sim FROM {p}dots CROSS JOIN (SELECT unnest({shrinks}) AS shrink)) WHERE sim > 0) WHERE rank <= 20""",
        f"{p}dots",
    )
    _add(f"{p}shown", f"SELECT s.*, u.fold, a.shrink, b.k AS cut FROM shown s JOIN folds2 u USING (user_id) CROSS JOIN (SELECT unnest({shrinks}) AS shrink) a CROSS JOIN (SELECT unnest({ks}) AS k) b", "shown folds2")
    _add(
        f"{p}lists",
        f"""SELECT fold, shrink, cut, user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY shrink, cut, user_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT v.fold, v.shrink, v.cut, v.user_id, n.j AS item_id, floor(sum(v.rating * n.sim) * 1e6 + 5e-1) / 1e6 AS score FROM {p}shown v JOIN {p}near n ON n.fold = v.fold AND n.shrink = v.shrink AND n.rank <= v.cut AND n.i = v.item_id
        JOIN items i ON i.item_id = n.j WHERE i.active AND NOT v.hidden GROUP BY 1, 2, 3, 4, 5) s
        ANTI JOIN (SELECT user_id, item_id FROM shown WHERE NOT hidden) m ON m.user_id = s.user_id AND m.item_id = s.item_id WHERE score > 0) WHERE rank <= 5""",
        f"{p}shown {p}near items",
    )
    _average_precisions(p, f"{p}shown", f"{p}lists", "fold, shrink, cut", f"{p}lists {p}shown")
    _add(f"{p}maps", f"SELECT CAST(fold AS INTEGER) AS fold, CAST(shrink AS BIGINT) AS shrink, CAST(cut AS BIGINT) AS k, floor(avg(ap) * 1e6 + 5e-1) / 1e6 AS map FROM {p}aps GROUP BY 1, 2, 3", f"{p}aps")


_grid("g", "r.rating", "[0, 10]", "[5, 20]")
_grid("e", "CAST(1 AS DOUBLE)", "[10]", "[20]")


def with_tables(select: str, *names: str) -> str:
    """The statement, after the common tables that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, "").split():
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " + select if order else select


def query(sql: str | None = None, *needs: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_tables(sql, *needs)
        return f

    return register


def r6(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 5e-1) / 1e6"


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return prep.max_per_pair(t.raw_interactions(spark, d))


def _all_raw(spark: SparkSession, d: str) -> DataFrame:
    return t.raw_interactions(spark, d, withhold=False)


def _content(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    return materialize(features.content_table(items, "item_id", ["brand", "size"], ["title", "tags"], items.count()), "content")


def _written_ratings(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_ratings(spark, d), "ratings")


def _near(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest(_written_ratings(spark, d), 50, 10)


def _content_near(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return similarity.content_nearest(_content(spark, d), k, 2)


def _lists(spark: SparkSession, d: str, ratings: DataFrame | None = None) -> DataFrame:
    ratings = _written_ratings(spark, d) if ratings is None else ratings
    return recommend.collaborative_top_n(ratings, t.items(spark, d), t.targets(spark, d))


# ---------------------------------------------------------------- the flagship


@query("SELECT user_id, item_id, score, rank FROM recs", "recs")
def top5_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("user_id", "item_id", "score", "rank")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT p_partkey AS id, p_name AS title, 0 AS career_level, p_type AS tags, CAST(p_size <= 40 AS INT) AS active_during_test FROM part")
def io1_items(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "items")
    written = t.items(spark, d).selectExpr("item_id AS id", "title", "CAST(NULL AS INT) AS career_level", "tags", "CAST(active AS INT) AS active_during_test")
    written.write.csv(path, sep="\t", header=True)
    return files.read_items(spark, path, "id long, title string, career_level int, tags string, active_during_test int")


@query("SELECT user_id, item_id, CAST(sum(interaction_type) AS DOUBLE) AS rating FROM raw GROUP BY 1, 2", "raw")
def io2_interactions(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "interactions")
    t.raw_interactions(spark, d).write.csv(path, sep="\t", header=True)
    return files.read_interactions(spark, path)


@query("SELECT user_id, segment AS jobroles, 0 AS career_level, CAST(nation AS VARCHAR) AS country, CAST(region AS INT) AS region FROM users", "users")
def io3_users(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "users")
    none = ["career_level", "discipline_id", "industry_id"], ["experience_n_entries_class", "experience_years_experience", "experience_years_in_current", "edu_degree", "edu_fieldofstudies"]
    nulls = [[F.lit(None).cast("int").alias(c) for c in part] for part in none]
    t.users(spark, d).select("user_id", F.col("segment").alias("jobroles"), *nulls[0], F.col("nation").alias("country"), "region", *nulls[1]).write.csv(path, sep="\t", header=True)
    return files.read_users(spark, path).select("user_id", "jobroles", "career_level", "country", "region")


@query("SELECT user_id FROM targets", "targets")
def io4_targets(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "targets")
    t.targets(spark, d).write.csv(path, header=True)
    return files.read_targets(spark, path)


@query("SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS recommended_items FROM recs GROUP BY 1", "recs")
def io5_submission(spark: SparkSession, d: str) -> DataFrame:
    return files.pack(_lists(spark, d))


@query("SELECT 'U' || user_id AS user_id, string_agg('P' || item_id, ' ' ORDER BY rank) AS recommended_items FROM recs GROUP BY 1", "recs")
def io5_natural_ids(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "named")
    users = t.users(spark, d).select("user_id", F.concat(F.lit("U"), "user_id").alias("name"))
    items = t.items(spark, d).select("item_id", F.concat(F.lit("P"), "item_id").alias("name"))
    files.write_recommendations(_lists(spark, d), path, users, items)
    return spark.read.csv(path, header=True, schema="user_id string, recommended_items string")


@query("SELECT user_id, rank, item_id FROM recs", "recs")
def io6_parsed_submission(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "submission")
    files.write_recommendations(_lists(spark, d), path)
    return files.read_recommendations(spark, path)


@query("SELECT i AS src_id, j AS dst_id, sim AS weight FROM cnear", "cnear")
def io7_stored_weights(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "weights")
    files.write_weights(similarity.as_weights(_near(spark, d)), path)
    return files.read_weights(spark, path)


@query("SELECT i, j, sim FROM isims", "isims")
def io8_stored_similarities(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "similarities")
    files.write_similarities(similarity.content_dots(_content(spark, d)), [0, 2, 50], path)
    return files.read_similarities(spark, path, 2)


@query("SELECT rank, item_id FROM popular WHERE rank <= 500", "popular")
def io9_popularity_list(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "popularity")
    files.write_popularity(ranking.popularity(_ratings(spark, d), t.items(spark, d)), path)
    return files.read_popularity(spark, path)


@query("SELECT shrink, k, floor(avg(map) * 1e6 + 5e-1) / 1e6 AS mean_map, floor(stddev_pop(map) * 1e6 + 5e-1) / 1e6 AS std_map FROM gmaps GROUP BY 1, 2", "gmaps")
def io10_score_table(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "scores")
    files.write_scores(ev8_grid_summary(spark, d), path)
    return spark.read.csv(path, sep="\t", header=True, schema="shrink long, k long, mean_map double, std_map double")


@query()
def io11_class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "probabilities")
    docs = _labelled(spark, d)
    files.write_probabilities(classify.class_probabilities(classify.text_classifier(docs, 0.01, 0.0), docs), path, 2)
    return spark.read.csv(path, header=True, schema="id long, p_0 double, p_1 double")


# ---------------------------------------------------------------- cleaning and aggregations


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM ulist", "ulist")
def pr1_dense_index(spark: SparkSession, d: str) -> DataFrame:
    return prep.dense_index(_ratings(spark, d), "user_id")


@query("SELECT 'user' AS kind, user_id AS id, count(*) AS n FROM raw ANTI JOIN targets USING (user_id) GROUP BY 2 UNION ALL SELECT 'item', item_id, count(*) FROM raw ANTI JOIN (SELECT item_id FROM items WHERE active) USING (item_id) GROUP BY 2", "raw", "items", "targets")
def pr1_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    return prep.unknown_ids(t.raw_interactions(spark, d), t.targets(spark, d), prep.active_items(t.items(spark, d)))


@query("SELECT * FROM aratings", "aratings")
def pr2_max_per_pair(spark: SparkSession, d: str) -> DataFrame:
    return prep.max_per_pair(_all_raw(spark, d))


@query("SELECT item_id, sum(rating) AS strength FROM aratings GROUP BY 1", "aratings")
def pr3_item_strength(spark: SparkSession, d: str) -> DataFrame:
    return prep.item_strength(_all_raw(spark, d))


@query("SELECT count(*) FILTER (n > 50) AS above_50, count(*) FILTER (n <= 50) AS at_most_50, count(*) FILTER (n <= 2) AS at_most_2 FROM (SELECT count(DISTINCT item_id) AS n FROM araw GROUP BY user_id)", "araw")
def pr4_activity(spark: SparkSession, d: str) -> DataFrame:
    return prep.activity_groups(_all_raw(spark, d))


@query("SELECT CAST(floor(n / 5.0) * 5 AS BIGINT) AS bin_start, count(*) AS n FROM (SELECT count(DISTINCT item_id) AS n FROM araw GROUP BY user_id) GROUP BY 1", "araw")
def pr5_histogram(spark: SparkSession, d: str) -> DataFrame:
    return prep.histogram(prep.user_activity(_all_raw(spark, d)), "n_items", 5)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(v) AS n, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std, min(v) AS least, {r6('quantile_cont(v, 0.25)')} AS q25, {r6('quantile_cont(v, 0.5)')} AS q50, {r6('quantile_cont(v, 0.75)')} AS q75, max(v) AS largest FROM (SELECT CAST({e} AS DOUBLE) AS v FROM part)"
        for c, e in (("size", "p_size"), ("price", "p_retailprice"))
    )
)
def pr6_describe_numbers(spark: SparkSession, d: str) -> DataFrame:
    return prep.describe_numbers(t.table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), ["size", "price"])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, (array_agg(v ORDER BY c DESC, v))[1] AS top, max(c) AS freq FROM (SELECT {c} AS v, count(*) AS c FROM items GROUP BY 1)" for c in ("title", "brand", "tags")
    ),
    "items",
)
def pr6_describe_strings(spark: SparkSession, d: str) -> DataFrame:
    return prep.describe_strings(t.items(spark, d), ["title", "brand", "tags"])


@query("SELECT user_id, item_id, CAST(1 AS DOUBLE) AS rating FROM aratings WHERE rating > 0", "aratings")
def pr7_implicit(spark: SparkSession, d: str) -> DataFrame:
    return prep.implicit(prep.max_per_pair(_all_raw(spark, d)))


@query(f"SELECT user_id, item_id, {r6('mu')} AS mu, {r6('item_bias')} AS item_bias, {r6('user_bias')} AS user_bias, {r6('residual')} AS residual FROM aeffects", "aeffects")
def pr8_global_effects(spark: SparkSession, d: str) -> DataFrame:
    found = prep.global_effects(prep.max_per_pair(_all_raw(spark, d)))
    return found.select("user_id", "item_id", *(rounded(F.col(c)).alias(c) for c in ("mu", "item_bias", "user_bias", "residual")))


@query("SELECT item_id FROM items WHERE active", "items")
def pr9_active_items(spark: SparkSession, d: str) -> DataFrame:
    return prep.active_items(t.items(spark, d))


@query("SELECT * FROM mine", "mine")
def pr10_of_targets(spark: SparkSession, d: str) -> DataFrame:
    return prep.of_targets(_ratings(spark, d), t.targets(spark, d))


@query("SELECT user_id FROM targets ANTI JOIN ratings USING (user_id)", "targets", "ratings")
def pr11_empty_profiles(spark: SparkSession, d: str) -> DataFrame:
    return prep.empty_profiles(t.targets(spark, d), _ratings(spark, d))


@query(f"SELECT user_id, item_id, {r6('rating / (sqrt(sum(rating * rating) OVER (PARTITION BY user_id)) + 1e-6)')} AS rating FROM ratings", "ratings")
def pr12_normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    return prep.l2_normalize(_ratings(spark, d), ["user_id"], "rating").select("user_id", "item_id", rounded(F.col("rating")).alias("rating"))


@query(f"SELECT user_id, item_id, {r6('rating / (sqrt(sum(rating * rating) OVER (PARTITION BY item_id)) + 1e-6)')} AS rating FROM ratings", "ratings")
def pr12_normalized_columns(spark: SparkSession, d: str) -> DataFrame:
    return prep.l2_normalize(_ratings(spark, d), ["item_id"], "rating").select("user_id", "item_id", rounded(F.col("rating")).alias("rating"))


@query(f"SELECT i AS src_id, j AS dst_id, {r6('sim / max(abs(sim)) OVER (PARTITION BY j)')} AS weight FROM cnear", "cnear")
def pr13_max_abs(spark: SparkSession, d: str) -> DataFrame:
    return prep.max_abs_scale(similarity.as_weights(materialize(_near(spark, d), "near"))).withColumn("weight", rounded(F.col("weight")))


# ---------------------------------------------------------------- content features


ITEM_WORDS = """SELECT item_id AS id, attr, unnest(regexp_extract_all(lower(v), '[a-z0-9_]+')) AS token FROM (
    SELECT item_id, unnest(['title', 'tags', 'brand', 'size']) AS attr, unnest([title, tags, brand, CAST(size AS VARCHAR)]) AS v FROM items)"""
ITEM_COUNTS = f"SELECT id, attr, token, CAST(count(*) AS DOUBLE) AS weight FROM ({ITEM_WORDS}) GROUP BY 1, 2, 3"
IDF = "(ln((1 + {n}) / CAST(1 + count(*) OVER (PARTITION BY attr, token) AS DOUBLE)) + 1)"


def tfidf_sql(counts: str, n: str, within: str) -> str:
    return f"SELECT id, attr, token, {r6(f'v / sqrt(sum(v * v) OVER (PARTITION BY {within}))')} AS weight FROM (SELECT *, weight * {IDF.format(n=n)} AS v FROM ({counts}))"


def _weights6(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", rounded(F.col("weight")))


@query(ITEM_WORDS, "items")
def fe1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.tokens(t.items(spark, d), "item_id", ["title", "tags", "brand", "size"])


@query(ITEM_COUNTS, "items")
def fe2_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.token_counts(features.tokens(t.items(spark, d), "item_id", ["title", "tags", "brand", "size"]))


@query(tfidf_sql(f"SELECT * FROM ({ITEM_COUNTS}) WHERE attr IN ('title', 'tags')", "(SELECT count(*) FROM items)", "id, attr"), "items")
def fe3_tfidf(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    return _weights6(features.tfidf(features.token_counts(features.tokens(items, "item_id", ["title", "tags"])), items.count(), ["id", "attr"]))


@query("SELECT user_id, nation || '_' || region AS location FROM users", "users")
def fe4_location(spark: SparkSession, d: str) -> DataFrame:
    return features.location(t.users(spark, d), "nation", "region").select("user_id", "location")


@query(
    f"SELECT * FROM ({ITEM_COUNTS}) WHERE attr IN ('brand', 'size') UNION ALL " + tfidf_sql(f"SELECT * FROM ({ITEM_COUNTS}) WHERE attr IN ('title', 'tags')", "(SELECT count(*) FROM items)", "id, attr"),
    "items",
)
def fe5_item_content(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    return _weights6(features.content_table(items, "item_id", ["brand", "size"], ["title", "tags"], items.count()))


@query(tfidf_sql(ITEM_COUNTS, "(SELECT count(*) FROM items)", "id"), "items")
def fe6_unified_content(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    return _weights6(features.unified_content(items, "item_id", ["title", "tags", "brand", "size"], items.count()))


@query(f"SELECT id, attr, token, {r6('weight')} AS weight FROM ucontent", "ucontent")
def fe7_user_content(spark: SparkSession, d: str) -> DataFrame:
    users = t.users(spark, d)
    return _weights6(recommend.user_content(users, users.count()))


NULL_COUNTS = ITEM_COUNTS.replace("CAST(size AS VARCHAR)", "CASE WHEN size > 25 THEN 'NULL' ELSE CAST(size AS VARCHAR) END")


@query(tfidf_sql(NULL_COUNTS, "(SELECT count(*) FROM items)", "id, attr"), "items")
def fe8_all_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes above 25 count as missing here, so that the null token is there."""
    items = t.items(spark, d).withColumn("size", F.when(F.col("size") <= 25, F.col("size")))
    words = features.tokens(items, "item_id", ["title", "tags", "brand", "size"], null_token="NULL")
    return _weights6(features.tfidf(features.token_counts(words), items.count(), ["id", "attr"]))


@query(
    f"SELECT user_id, item_id, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY user_id))')} AS weight FROM (SELECT *, rating * (ln((1 + (SELECT count(DISTINCT user_id) FROM ratings)) / CAST(1 + count(*) OVER (PARTITION BY item_id) AS DOUBLE)) + 1) AS v FROM ratings)",
    "ratings",
)
def fe9_rating_tfidf(spark: SparkSession, d: str) -> DataFrame:
    ratings = _ratings(spark, d)
    return _weights6(features.rating_tfidf(ratings, ratings.select("user_id").distinct().count()))


@query()
def fe10_attribute_importance(spark: SparkSession, d: str) -> DataFrame:
    return features.attribute_importance(_ratings(spark, d), t.items(spark, d), ["title", "tags", "brand", "size"])


# ---------------------------------------------------------------- similarity


@query(f"SELECT i, j, {r6('dot')} AS dot, co FROM idots", "idots")
def si1_content_dots(spark: SparkSession, d: str) -> DataFrame:
    return similarity.content_dots(_content(spark, d)).withColumn("dot", rounded(F.col("dot")))


@query("SELECT i, j, sim FROM isims WHERE sim > 0", "isims")
def si2_shrunk(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similarities(similarity.content_dots(_content(spark, d)), 2)


@query("SELECT * FROM inear", "inear")
def si3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _content_near(spark, d)


@query("SELECT i, j, sim FROM isims WHERE sim > 0 AND i IN (SELECT item_id FROM mine)", "isims", "mine")
def si4_rated_rows(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similarities(similarity.content_dots(_content(spark, d), _mine(spark, d).select(F.col("item_id").alias("id"))), 2)


@query("SELECT * FROM inear WHERE i IN (SELECT item_id FROM items WHERE active)", "inear", "items")
def si5_nearest_of_active(spark: SparkSession, d: str) -> DataFrame:
    active = prep.active_items(t.items(spark, d)).select(F.col("item_id").alias("id"))
    return similarity.content_nearest(_content(spark, d), 20, 2, left=active)


@query("SELECT * FROM cnear", "cnear")
def si6_collaborative(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@query("SELECT i, j, sim, rank FROM (SELECT j AS i, i AS j, sim, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) AS rank FROM cnear) WHERE rank <= 10", "cnear")
def si7_from_weights(spark: SparkSession, d: str) -> DataFrame:
    return similarity.weights_to_neighbours(similarity.as_weights(_near(spark, d)), 10)


@query("SELECT * FROM unear", "unear")
def si8_cold_users(spark: SparkSession, d: str) -> DataFrame:
    users, ratings = t.users(spark, d), _ratings(spark, d)
    cold = prep.empty_profiles(t.targets(spark, d), ratings)
    return recommend.user_neighbours(users, cold, ratings, users.count(), 3)


@query("SELECT * FROM inear WHERE rank <= 7", "inear")
def si9_cut(spark: SparkSession, d: str) -> DataFrame:
    return similarity.cut(_content_near(spark, d), 7)


# ---------------------------------------------------------------- learned weights


@query("SELECT * FROM agram", "agram")
def lw1_gram(spark: SparkSession, d: str) -> DataFrame:
    return linear.gram(materialize(prep.max_per_pair(_all_raw(spark, d)), "ratings"))


#: Gram entries of the pairs (a, b) of a table alone
PAIR_GRAM = "(SELECT p.a, p.b, sum(x.rating * y.rating) AS g FROM (SELECT DISTINCT a, b FROM {pairs}) p JOIN ratings x ON x.item_id = p.a JOIN ratings y ON y.item_id = p.b AND y.user_id = x.user_id GROUP BY 1, 2)"


@query(
    f"SELECT n.j AS src_id, n.i AS dst_id, {r6('c.g / (o.g + 20e0)')} AS weight FROM (SELECT * FROM cnear WHERE rank = 1) n JOIN {PAIR_GRAM.format(pairs='(SELECT i AS a, j AS b FROM cnear WHERE rank = 1)')} c ON c.a = n.i AND c.b = n.j JOIN (SELECT item_id, sum(rating * rating) AS g FROM ratings GROUP BY 1) o ON o.item_id = n.j",
    "cnear", "ratings",
)
def lw2_one_feature_ridge(spark: SparkSession, d: str) -> DataFrame:
    profiles = pairs.profiles(_written_ratings(spark, d))
    return linear.one_feature_ridge_of(pairs.nearest(profiles, 1, 10), profiles, 20.0)


@query()
def lw2_slim_ridge(spark: SparkSession, d: str) -> DataFrame:
    """All other items are features of each."""
    return allitems.slim_ridge_all(materialize(_ratings(spark, d), "ratings"), 50.0)


def _popular(spark: SparkSession, d: str, ratings: DataFrame, n: int) -> DataFrame:
    items = t.items(spark, d)
    return linear.popular_targets(ranking.popularity(ratings, items), items, n)


@query()
def lw2_popular_ridge(spark: SparkSession, d: str) -> DataFrame:
    """All other items as features, the 100 most popular active items as targets."""
    ratings = materialize(_ratings(spark, d), "ratings")
    return allitems.slim_ridge_all(ratings, 50.0, _popular(spark, d, ratings, 100))


@query()
def lw2_corated_ridge(spark: SparkSession, d: str) -> DataFrame:
    """All co-rated items as features, on the event stream's small catalogue."""
    ratings = materialize(prep.max_per_pair(t.event_interactions(spark, d)), "ratings")
    gram = materialize(linear.gram(ratings), "gram")
    return linear.slim_ridge(linear.corated(gram), gram, 50.0)


@query()
def lw3_slim_elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """All other items as features, the 200 most popular active items as targets."""
    ratings = materialize(_ratings(spark, d), "ratings")
    return allitems.slim_elastic_net_all(ratings, 0.002, 0.01, _popular(spark, d, ratings, 200))


@query()
def lw4_slim_lasso(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(_ratings(spark, d), "ratings")
    return allitems.slim_lasso_all(ratings, 0.002, _popular(spark, d, ratings, 200))


@query("SELECT item_id FROM popular SEMI JOIN (SELECT item_id FROM items WHERE active) USING (item_id) ORDER BY rank LIMIT 100", "popular", "items")
def lw5_popular_targets(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    return linear.popular_targets(ranking.popularity(_ratings(spark, d), items), items, 100)


@query()
def lw6_neighbour_slim(spark: SparkSession, d: str) -> DataFrame:
    profiles = pairs.profiles(_written_ratings(spark, d))
    return linear.slim_ridge_of(pairs.nearest(profiles, 15, 10), profiles, 20.0)


TWO = "(SELECT i, min(j) FILTER (rank = 1) AS j1, min(j) FILTER (rank = 2) AS j2 FROM {near} WHERE rank <= 2 GROUP BY i)"
PAIRS_OF_TWO = "(SELECT i AS a, j1 AS b FROM {two} UNION SELECT i, j2 FROM {two} UNION SELECT j1, j2 FROM {two} UNION SELECT j1, j1 FROM {two} UNION SELECT j2, j2 FROM {two})"


def two_neighbours_sql(near: str) -> str:
    """The ridge of two features in closed form, penalty 20."""
    two = TWO.format(near=near)
    g = PAIR_GRAM.format(pairs=PAIRS_OF_TWO.format(two=two))
    part = f"""(SELECT t.i, t.j1, t.j2, coalesce(a.g, 0) AS g1, coalesce(b.g, 0) AS g2, coalesce(c.g, 0) AS g12, coalesce(e.g, 0) + 20e0 AS g11, coalesce(f.g, 0) + 20e0 AS g22 FROM {two} t
      LEFT JOIN pg a ON a.a = t.i AND a.b = t.j1 LEFT JOIN pg b ON b.a = t.i AND b.b = t.j2 LEFT JOIN pg c ON c.a = t.j1 AND c.b = t.j2
      LEFT JOIN pg e ON e.a = t.j1 AND e.b = t.j1 LEFT JOIN pg f ON f.a = t.j2 AND f.b = t.j2)"""
    return f"""SELECT src_id, dst_id, {r6("w")} AS weight FROM (WITH pg AS (SELECT * FROM {g})
      SELECT j1 AS src_id, i AS dst_id, (g22 * g1 - g12 * g2) / (g11 * g22 - g12 * g12) AS w FROM {part}
      UNION ALL SELECT j2, i, (g11 * g2 - g12 * g1) / (g11 * g22 - g12 * g12) FROM {part} WHERE j2 IS NOT NULL) WHERE w > 0"""


@query(two_neighbours_sql("cnear"), "cnear", "ratings")
def lw6_two_neighbours(spark: SparkSession, d: str) -> DataFrame:
    profiles = pairs.profiles(_written_ratings(spark, d))
    return linear.slim_ridge_of(pairs.nearest(profiles, 2, 10), profiles, 20.0).withColumn("weight", rounded(F.col("weight")))


@query(two_neighbours_sql("inear"), "inear", "ratings")
def lw6_two_content_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return linear.slim_ridge_of(_content_near(spark, d, 2), _written_ratings(spark, d), 20.0).withColumn("weight", rounded(F.col("weight")))


@query()
def lw6_content_slim(spark: SparkSession, d: str) -> DataFrame:
    return linear.slim_ridge_of(_content_near(spark, d), _written_ratings(spark, d), 20.0)


@query()
def lw7_user_slim(spark: SparkSession, d: str) -> DataFrame:
    return allitems.user_slim_all(materialize(_ratings(spark, d), "ratings"), 50.0)


@query()
def lw8_scm_ridge(spark: SparkSession, d: str) -> DataFrame:
    return allitems.scm_all(materialize(_ratings(spark, d), "ratings"), "ridge", 50.0)


@query()
def lw8_scm_logistic(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(prep.implicit(_ratings(spark, d)), "ratings")
    return allitems.scm_all(ratings, "logistic", 0.1, _popular(spark, d, ratings, 200))


@query()
def lw8_scm_svm(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(prep.implicit(_ratings(spark, d)), "ratings")
    return allitems.scm_all(ratings, "svm", 0.01, _popular(spark, d, ratings, 200))


@query()
def lw9_neighbour_scm(spark: SparkSession, d: str) -> DataFrame:
    """Features are neighbours by content. Ratings are those of the event stream, where an item is rated
    by about half of the users: a classifier without an intercept has no weight above 0 on rare ones."""
    ratings = materialize(prep.max_per_pair(t.event_interactions(spark, d)), "ratings")
    rated = ratings.select(F.col("item_id").alias("id")).distinct()
    return linear.scm(similarity.content_nearest(_content(spark, d), 10, 2, rated, rated), ratings, "svm", 0.1)


@query()
def lw10_refit(spark: SparkSession, d: str) -> DataFrame:
    profiles = pairs.profiles(_written_ratings(spark, d))
    first = linear.slim_ridge_of(pairs.strongest(profiles, 20), profiles, 50.0)
    return linear.refit(first, profiles, 50.0, 10, 2, linear.slim_ridge_of)


@query()
def lw11_nmf(spark: SparkSession, d: str) -> DataFrame:
    return factors.nmf(materialize(_ratings(spark, d), "ratings"), 4, 3, l2=0.1)[1]


@query()
def lw12_observed_factors(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(_ratings(spark, d), "ratings")
    return factors.observed_objective(ratings, *factors.observed_factors(ratings, 8, 0.1, 5), 0.1)


@query()
def lw12_gradient_factors(spark: SparkSession, d: str) -> DataFrame:
    """What each step of the descent found, with both bias columns."""
    found = factors.gradient_factors(materialize(_ratings(spark, d), "ratings"), 4, 0.5, 0.002, True, True, max_steps=8, min_change=1.0)
    return spark.createDataFrame(found[2], "step int, error double, gradient double, change double")


@query()
def lw13_singular_values(spark: SparkSession, d: str) -> DataFrame:
    return factors.singular_values(materialize(_ratings(spark, d), "ratings"), 6, tolerance=1e-3)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(t.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id")


@query()
def lw14_text_classifier(spark: SparkSession, d: str) -> DataFrame:
    return classify.tune_classifier(_labelled(spark, d), [0.01, 0.1], [0.0, 0.5])


# ---------------------------------------------------------------- scores, masks and ranks


@query("SELECT * FROM popular", "popular")
def rk1_popularity(spark: SparkSession, d: str) -> DataFrame:
    return ranking.popularity(_ratings(spark, d), t.items(spark, d))


@query(f"SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM (SELECT i.item_id, {r6('coalesce(sum(e.residual), 0)')} AS score FROM items i LEFT JOIN effects e USING (item_id) GROUP BY 1)", "items", "effects")
def rk1b_popularity_of_residuals(spark: SparkSession, d: str) -> DataFrame:
    left = prep.global_effects(_ratings(spark, d)).select("user_id", "item_id", F.col("residual").alias("rating"))
    return ranking.popularity(left, t.items(spark, d), by="sum")


_add(
    "pop5",
    "SELECT user_id, item_id, score, rank FROM (SELECT t.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY t.user_id ORDER BY p.rank) AS rank FROM targets t CROSS JOIN (SELECT p.* FROM popular p SEMI JOIN (SELECT item_id FROM items WHERE active) USING (item_id)) p ANTI JOIN ratings r ON r.user_id = t.user_id AND r.item_id = p.item_id) WHERE rank <= 5",
    "targets popular items ratings",
)


@query("SELECT * FROM pop5", "pop5")
def rk2_popular_unseen(spark: SparkSession, d: str) -> DataFrame:
    ratings, items = _ratings(spark, d), t.items(spark, d)
    return ranking.popular_unseen(ranking.popularity(ratings, items), items, ratings, t.targets(spark, d), 5)


def _mine(spark: SparkSession, d: str, ratings: DataFrame | None = None) -> DataFrame:
    return prep.of_targets(_ratings(spark, d) if ratings is None else ratings, t.targets(spark, d))


def _scores(spark: SparkSession, d: str, ratings: DataFrame | None = None, weights: Callable[[DataFrame], DataFrame] = similarity.as_weights, active: bool = True, **how) -> DataFrame:
    """What the neighbours' items score for targets; with ``active`` only those that may be recommended."""
    ratings, items = _written_ratings(spark, d) if ratings is None else ratings, t.items(spark, d)
    every = items if active else items.withColumn("active", F.lit(True))
    return pairs.scores(_mine(spark, d, ratings), weights(pairs.nearest(ratings, 50, 10)), every, **how)


@query(f"SELECT m.user_id, w.j AS item_id, {r6('sum(m.rating * w.sim)')} AS score FROM mine m JOIN cnear w ON m.item_id = w.i GROUP BY 1, 2", "mine", "cnear")
def rk3_item_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, active=False)


@query(f"SELECT m.user_id, w.i AS item_id, {r6('sum(m.rating * w.sim)')} AS score FROM mine m JOIN cnear w ON m.item_id = w.j GROUP BY 1, 2", "mine", "cnear")
def rk4_neighbour_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, weights=similarity.as_candidates, active=False)


@query(f"SELECT m.user_id, w.j AS item_id, {r6('sum(m.rating * w.sim) / CASE WHEN abs(sum(w.sim)) < 1e-6 THEN 1 ELSE sum(w.sim) END')} AS score FROM mine m JOIN cnear w ON m.item_id = w.i GROUP BY 1, 2", "mine", "cnear")
def rk5_normalized_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, active=False, normalize=True)


@query(f"SELECT n.i AS user_id, r.item_id, {r6('sum(n.sim * r.rating)')} AS score FROM unear n JOIN ratings r ON r.user_id = n.j GROUP BY 1, 2", "unear", "ratings")
def rk6_user_scores(spark: SparkSession, d: str) -> DataFrame:
    near = si8_cold_users(spark, d).select(F.col("j").alias("src_id"), F.col("i").alias("dst_id"), F.col("sim").alias("weight"))
    return ranking.user_scores(_ratings(spark, d), near)


@query(f"SELECT *, {r6('1 / (1 + exp(-score))')} AS probability FROM scores", "scores")
def rk7_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.with_sigmoid(_scores(spark, d))


@query()
def rk8_factor_scores(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(_ratings(spark, d), "ratings")
    p, q = factors.nmf(ratings, 4, 3, l2=0.1)
    return factors.factor_scores(p, q, t.targets(spark, d), ratings, prep.active_items(t.items(spark, d)), 5)


@query("SELECT * FROM unseen", "unseen")
def rk9_unseen(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, unseen=True)


@query("SELECT * FROM scores", "scores")
def rk10_active_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query("SELECT * FROM lists", "lists")
def rk11_top_n(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, unseen=True, n=5)


@query("SELECT * FROM recs", "recs")
def rk12_fallback(spark: SparkSession, d: str) -> DataFrame:
    ratings, items = _written_ratings(spark, d), t.items(spark, d)
    return ranking.with_fallback(materialize(_scores(spark, d, ratings, unseen=True, n=5), "lists"), t.targets(spark, d), ranking.popularity(ratings, items), items, 5)


_add("wide", "SELECT * FROM lists WHERE score > 2", "lists")


@query(
    """SELECT user_id, item_id, score, rank FROM wide UNION ALL SELECT user_id, item_id, CAST(0 AS DOUBLE), own + k FROM (
      SELECT t.user_id, p.item_id, coalesce(o.own, 0) AS own, row_number() OVER (PARTITION BY t.user_id ORDER BY p.rank) AS k FROM targets t CROSS JOIN (SELECT p.* FROM popular p SEMI JOIN (SELECT item_id FROM items WHERE active) USING (item_id)) p
      LEFT JOIN (SELECT user_id, count(*) AS own FROM wide GROUP BY 1) o USING (user_id)
      ANTI JOIN (SELECT user_id, item_id FROM ratings UNION ALL SELECT user_id, item_id FROM wide) r ON r.user_id = t.user_id AND r.item_id = p.item_id) WHERE own + k <= 5""",
    "wide", "targets", "popular", "items", "ratings",
)
def rk12_padded(spark: SparkSession, d: str) -> DataFrame:
    """Lists of scores above 2, filled up with popular items."""
    ratings, items = _written_ratings(spark, d), t.items(spark, d)
    return ranking.padded(materialize(_scores(spark, d, ratings, unseen=True, n=5), "lists").filter("score > 2"), t.targets(spark, d), ranking.popularity(ratings, items), items, ratings, 5)


LENT = "(SELECT n.i AS user_id, r.item_id, r.rating FROM unear n JOIN ratings r ON r.user_id = n.j WHERE n.rank = 1 UNION ALL SELECT * FROM mine)"


_add("lent", LENT.strip("()"), "unear ratings mine")
_add(
    "coldlists",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT m.user_id, w.j AS item_id, {r6('sum(m.rating * w.sim)')} AS score FROM lent m
        JOIN cnear w ON m.item_id = w.i SEMI JOIN (SELECT item_id AS j FROM items WHERE active) a ON a.j = w.j GROUP BY 1, 2) s
        ANTI JOIN ratings r ON r.user_id = s.user_id AND r.item_id = s.item_id WHERE score > 0) WHERE rank <= 5""",
    "lent cnear items ratings",
)
_add("coldrecs", "SELECT user_id, item_id, score, rank FROM coldlists UNION ALL SELECT t.user_id, h.item_id, CAST(0 AS DOUBLE), h.rank FROM (SELECT * FROM targets ANTI JOIN coldlists USING (user_id)) t CROSS JOIN head h", "coldlists targets head")


@query("SELECT * FROM coldrecs", "coldrecs")
def rk13_cold_recommendations(spark: SparkSession, d: str) -> DataFrame:
    ratings, users = _ratings(spark, d), t.users(spark, d)
    return recommend.cold_top_n(ratings, users, t.items(spark, d), t.targets(spark, d), similarity.as_weights(_near(spark, d)), users.count())


# ---------------------------------------------------------------- hybrids


@query(
    f"SELECT coalesce(a.i, b.i) AS src_id, coalesce(a.j, b.j) AS dst_id, {r6('7e-1 * coalesce(a.w, 0) + (1e0 - 7e-1) * coalesce(b.w, 0)')} AS weight FROM (SELECT i, j, sim / max(sim) OVER (PARTITION BY j) AS w FROM cnear) a FULL JOIN (SELECT i, j, sim / max(sim) OVER (PARTITION BY j) AS w FROM inear) b ON a.i = b.i AND a.j = b.j",
    "cnear", "inear",
)
def hy1_blend(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.blend(similarity.as_weights(_near(spark, d)), similarity.as_weights(_content_near(spark, d)), 0.7)


@query("SELECT user_id, item_id, CAST(1 AS DOUBLE) AS rating FROM (SELECT user_id, item_id FROM ratings UNION SELECT user_id, item_id FROM recs)", "ratings", "recs")
def hy2_enriched(spark: SparkSession, d: str) -> DataFrame:
    ratings = _written_ratings(spark, d)
    return hybrid.enrich(ratings, _lists(spark, d, ratings))


@query()
def hy3_self_training(spark: SparkSession, d: str) -> DataFrame:
    """Ridge weights on neighbours by content, fitted on implicit and enriched ratings."""
    ratings, items = materialize(_ratings(spark, d), "ratings"), t.items(spark, d)
    return recommend.enriched_slim(ratings, items, t.targets(spark, d), materialize(_content_near(spark, d), "near"), 50.0, [2, 2, 1])


@query()
def hy3_enriched_scm(spark: SparkSession, d: str) -> DataFrame:
    """Classifiers on neighbours by content, fitted on implicit and enriched ratings of the event stream;
    lists for all of its users."""
    ratings = materialize(prep.max_per_pair(t.event_interactions(spark, d)), "ratings")
    rated = ratings.select(F.col("item_id").alias("id")).distinct()
    near = materialize(similarity.content_nearest(_content(spark, d), 10, 2, rated, rated), "near")
    return recommend.enriched_scm(ratings, t.items(spark, d), ratings.select("user_id").distinct(), near, "svm", 0.1, [2, 1])


def _lottery_tables(lists: list[str], shares: list[str], decay: str) -> tuple[str, dict[str, str]]:
    """The recursive draw over ranked lists: the statement's last part, and the tables it needs."""
    n = len(lists)
    left = [f"len(l{k})" for k in range(n)]
    rows = " UNION ALL ".join(f"SELECT user_id, item_id, rank, {k} AS source FROM {name}" for k, name in enumerate(lists))
    lots = f"SELECT user_id, {', '.join(f'coalesce(list(item_id ORDER BY rank) FILTER (source = {k}), []) AS l{k}' for k in range(n))} FROM ({rows}) GROUP BY user_id"
    going = f"len(items) < 5 AND {' + '.join(left)} > 0"
    weights = ", ".join(f"CASE WHEN {left[k]} > 0 THEN {shares[k]} * pow({decay}, {left[k]} - 5) ELSE 0e0 END AS w{k}" for k in range(n))
    choice = " ".join(f"WHEN w{k} > 0 AND ({' + '.join(f'w{m}' for m in range(k + 1))} > place OR {' + '.join(left[k + 1 :])} = 0) THEN {k}" for k in range(n - 1))
    head = " ".join(f"WHEN {k} THEN l{k}[1]" for k in range(n))
    taken = ", ".join(f"CASE WHEN c = {k} THEN l{k}[2:] ELSE l{k} END" for k in range(n))
    draw = "CAST('0x' || substr(md5('1:' || user_id || ':' || step), 1, 8) AS BIGINT) / 4294967296e0"
    lot = f"""SELECT user_id, {', '.join(f'l{k}' for k in range(n))}, 0 AS step, CAST([] AS BIGINT[]) AS items, CAST([] AS INTEGER[]) AS sources FROM lots
      UNION ALL SELECT user_id, {taken}, step + 1, CASE WHEN list_contains(items, head) THEN items ELSE list_append(items, head) END, CASE WHEN list_contains(items, head) THEN sources ELSE list_append(sources, CAST(c AS INTEGER)) END
      FROM (SELECT *, CASE c {head} END AS head FROM (SELECT *, CASE {choice} ELSE {n - 1} END AS c FROM (SELECT *, draw * ({' + '.join(f'w{k}' for k in range(n))}) AS place FROM (SELECT *, {weights}, {draw} AS draw FROM lot WHERE {going}))))"""
    return f"SELECT user_id, CAST(unnest(range(1, len(items) + 1)) AS INTEGER) AS rank, unnest(items) AS item_id, unnest(sources) AS source FROM lot WHERE NOT ({going})", {"lots": lots, "lot": lot}


def _lottery_sql(lists: list[str], shares: list[str], decay: str, around: str = "{}") -> str:
    last, tables = _lottery_tables(lists, shares, decay)
    before = with_tables("", *lists).strip().replace("WITH ", "WITH RECURSIVE ", 1)
    return before + ", " + ", ".join(f"{n} AS ({q})" for n, q in tables.items()) + " " + around.format(last)


FOUR = (["recs", "pop5", "coldrecs", "wrecs"], ["27e-2", "26e-2", "24e-2", "23e-2"], "15e-1")


@query(_lottery_sql(*FOUR))
def hy4_lottery(spark: SparkSession, d: str) -> DataFrame:
    lists = [_lists(spark, d), rk2_popular_unseen(spark, d), rk13_cold_recommendations(spark, d), w1_content_top5(spark, d)]
    return hybrid.lottery(lists, [0.27, 0.26, 0.24, 0.23])


@query(_lottery_sql(*FOUR, around="SELECT source, rank, count(*) AS n FROM ({}) GROUP BY 1, 2"))
def hy4_source_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.source_frequencies(hy4_lottery(spark, d))


@query(_lottery_sql(["recs", "pop5"], ["5e-1", "5e-1"], "1e0"))
def hy5_coin_flip(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.coin_flip(_lists(spark, d), rk2_popular_unseen(spark, d))


@query("SELECT * FROM icounts UNION ALL SELECT id, attr, token, weight FROM ucounts", "icounts", "ucounts")
def hy6_stacked(spark: SparkSession, d: str) -> DataFrame:
    items = features.token_counts(features.tokens(t.items(spark, d), "item_id", ["title", "tags", "brand", "size"]))
    users = features.token_counts(features.tokens(features.location(t.users(spark, d), "nation", "region"), "user_id", ["segment", "location"]))
    return hybrid.stacked_blocks([items, users])


# ---------------------------------------------------------------- evaluation


@query("SELECT * FROM sampled", "sampled")
def ev1_sample_users(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sample_users(_ratings(spark, d), 200, 7)


@query(f"SELECT DISTINCT user_id, {r6('user_bias')} AS user_bias FROM effects SEMI JOIN sampled USING (user_id)", "effects", "sampled")
def ev1_sample_biases(spark: SparkSession, d: str) -> DataFrame:
    ratings = _ratings(spark, d)
    biases = prep.global_effects(ratings).groupBy("user_id").agg(rounded(F.min("user_bias")).alias("user_bias"))
    return evaluate.sample_users(ratings, 200, 7, biases)[1]


@query("SELECT item_id, title, active FROM items SEMI JOIN isample USING (item_id)", "items", "isample")
def ev2_sample_items(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    counts = features.token_counts(features.tokens(items, "item_id", ["brand"]))
    return evaluate.of_sample(ev2_sample_interactions(spark, d), items, counts)[0].select("item_id", "title", "active")


@query("SELECT id, attr, token, weight FROM icounts WHERE id IN (SELECT item_id FROM isample)", "icounts", "isample")
def ev2_sample_content(spark: SparkSession, d: str) -> DataFrame:
    items = t.items(spark, d)
    counts = features.token_counts(features.tokens(items, "item_id", ["title", "tags", "brand", "size"]))
    return evaluate.of_sample(ev2_sample_interactions(spark, d), items, counts)[1]


@query("SELECT * FROM isample", "isample")
def ev2_sample_interactions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sample_interactions(_ratings(spark, d), 5000, 7)


@query("SELECT user_id, ntile(4) OVER (ORDER BY user_id) - 1 AS fold FROM ulist", "ulist")
def ev3_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.folds(_ratings(spark, d), 4)


@query("SELECT user_id, ntile(4) OVER (ORDER BY md5('5:' || user_id), user_id) - 1 AS fold FROM ulist", "ulist")
def ev3_shuffled_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.folds(_ratings(spark, d), 4, seed=5)


@query("SELECT user_id, item_id, rating, hidden FROM shown", "shown")
def ev4_hidden(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hide(_ratings(spark, d), 3)


def _popular_of_visible(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shown = materialize(evaluate.hide(_ratings(spark, d), 3), "shown")
    visible, items = shown.filter("not hidden").drop("hidden"), t.items(spark, d)
    everyone = shown.select("user_id").distinct()
    return ranking.popular_unseen(ranking.popularity(visible, items), items, visible, everyone, 5), shown.filter("hidden")


def _recommend_popular(spark: SparkSession, d: str) -> evaluate.Recommender:
    items = t.items(spark, d)
    return lambda ratings, profiles, _: ranking.popular_unseen(ranking.popularity(ratings, items), items, profiles, profiles.select("user_id").distinct(), 5)


@query(f"SELECT {r6('avg(ap)')} AS map, count(*) AS n_users FROM haps", "haps")
def ev5_holdout(spark: SparkSession, d: str) -> DataFrame:
    visible, hidden = evaluate.holdout(_ratings(spark, d), 0.5, 3)
    return evaluate.mean_average_precision(_recommend_popular(spark, d)(visible, visible, {}), hidden)


@query(f"SELECT rep, {r6('avg(ap)')} AS map, count(*) AS n_users FROM raps GROUP BY 1", "raps")
def ev6_scored_splits(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.repeated_splits(_ratings(spark, d), _recommend_popular(spark, d), {}, 9, 3)


@query("SELECT user_id, item_id, rating, rep, hidden AS test FROM splits", "splits")
def ev6_repeated_splits(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.split_interactions(_ratings(spark, d), 9, 3)


@query("SELECT user_id, ap FROM aps", "aps")
def ev7_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average_precision(*_popular_of_visible(spark, d))


@query("SELECT shrink, k, floor(avg(map) * 1e6 + 5e-1) / 1e6 AS mean_map, floor(stddev_pop(map) * 1e6 + 5e-1) / 1e6 AS std_map FROM gmaps GROUP BY 1, 2", "gmaps")
def ev8_grid_summary(spark: SparkSession, d: str) -> DataFrame:
    ratings = materialize(_ratings(spark, d), "ratings")
    found = evaluate.neighbour_grid(ratings, prep.active_items(t.items(spark, d)), [0, 10], [5, 20], 2, 3)
    return evaluate.summarise(found, ["shrink", "k"])


FOLD_MAPS = "(SELECT f.fold, s.seg AS facet, avg(a.ap) AS map FROM aps a JOIN (SELECT user_id, ntile(4) OVER (ORDER BY user_id) - 1 AS fold FROM ulist) f USING (user_id) JOIN (SELECT user_id, segment AS seg FROM users) s USING (user_id) GROUP BY 1, 2)"


def _fold_maps(spark: SparkSession, d: str) -> DataFrame:
    per_user = evaluate.average_precision(*_popular_of_visible(spark, d))
    joined = per_user.join(evaluate.folds(_ratings(spark, d), 4), "user_id").join(t.users(spark, d).select("user_id", F.col("segment").alias("facet")), "user_id")
    return joined.groupBy("fold", "facet").agg(F.avg("ap").alias("map"))


@query(f"SELECT facet, {r6('avg(map)')} AS mean_map, {r6('stddev_pop(map)')} AS std_map FROM {FOLD_MAPS} GROUP BY 1", "aps", "ulist", "users")
def ev8_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summarise(_fold_maps(spark, d), ["facet"])


@query(f"SELECT facet, mean_map FROM (SELECT facet, {r6('avg(map)')} AS mean_map FROM {FOLD_MAPS} GROUP BY 1) ORDER BY mean_map DESC, facet LIMIT 1", "aps", "ulist", "users")
def ev9_best_setting(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_setting(evaluate.summarise(_fold_maps(spark, d), ["facet"]), ["facet"])


@query(f"SELECT facet, fold, mean_map FROM (SELECT facet, fold, {r6('avg(map)')} AS mean_map, row_number() OVER (PARTITION BY facet ORDER BY {r6('avg(map)')} DESC, fold) AS n FROM {FOLD_MAPS} GROUP BY 1, 2) WHERE n = 1", "aps", "ulist", "users")
def ev9_best_per_facet(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_per_facet(evaluate.summarise(_fold_maps(spark, d), ["facet", "fold"]), "facet", ["facet", "fold"])


@query("SELECT rep, id, label, k <= floor(CAST(0.25 AS DOUBLE) * n) AS test FROM (SELECT rep, doc_id AS id, quality AS label, row_number() OVER (PARTITION BY rep, quality ORDER BY md5('4:' || rep || ':' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY rep, quality) AS n FROM labels CROSS JOIN (SELECT unnest([0, 1]) AS rep))")
def ev10_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    labels = t.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return classify.stratified_split(labels, 2, 0.25, 4).select("rep", "id", "label", "test")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Long texts are taken for good ones."""
    long = F.char_length("text") > 1500
    return _labelled(spark, d).select("id", "label", long.cast("int").alias("prediction"), F.when(long, 0.75).otherwise(0.5).alias("probability"))


@query(f"SELECT {r6('avg(-ln(CASE WHEN label = prediction THEN CAST(probability AS DOUBLE) ELSE 1 - CAST(probability AS DOUBLE) END))')} AS log_loss, count(*) AS n FROM predicted", "predicted")
def ev11_log_loss(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("label") == F.col("prediction"), F.col("probability")).otherwise(1 - F.col("probability"))
    return classify.log_loss(_predicted(spark, d).select("label", own.alias("probability")))


@query(f"SELECT label, prediction, {r6('count(*) / 2e0')} AS mean_n FROM predicted GROUP BY 1, 2", "predicted")
def ev12_confusion(spark: SparkSession, d: str) -> DataFrame:
    return classify.confusion(_predicted(spark, d), 2)


@query(
    f"SELECT c.label, c.prediction, c.mean_n, w.r AS \"right\" FROM (SELECT label, prediction, {r6('count(*) / 2e0')} AS mean_n FROM predicted GROUP BY 1, 2) c JOIN (SELECT label, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS r FROM (SELECT label, prediction, {r6('count(*) / 2e0')} AS n FROM predicted GROUP BY 1, 2) GROUP BY 1) w USING (label) WHERE c.label <> c.prediction AND c.mean_n > 0",
    "predicted",
)
def ev13_weak_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of every class, however often it is right: a fixed count would leave out all classes of a large table."""
    return classify.weak_classes(classify.confusion(_predicted(spark, d), 2), least=float("inf"))


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents, predicted from their words in three splits."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("label"))
    return classify.repeated_predictions(docs, 3, 0.01)


@query()
def ev11_fitted_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return classify.log_loss(_fitted(spark, d))


@query()
def ev12_fitted_confusion(spark: SparkSession, d: str) -> DataFrame:
    return classify.confusion(_fitted(spark, d), 3)


@query()
def ev13_fitted_weak_classes(spark: SparkSession, d: str) -> DataFrame:
    return classify.weak_classes(classify.confusion(_fitted(spark, d), 3), least=1.8)


@query("SELECT shrink, k, fold, map FROM emaps", "emaps")
def ev14_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Fit on implicit ratings, score and hide the explicit ones."""
    explicit = materialize(_ratings(spark, d), "ratings")
    return evaluate.neighbour_grid(prep.implicit(explicit), prep.active_items(t.items(spark, d)), [10], [20], 2, 3, profiles=explicit).select("shrink", "k", "fold", "map")


@query("SELECT user_id, item_id, score, rank FROM wrecs", "wrecs")
def w1_content_top5(spark: SparkSession, d: str) -> DataFrame:
    return recommend.content_top_n(_ratings(spark, d), t.items(spark, d), t.targets(spark, d), _content(spark, d))
