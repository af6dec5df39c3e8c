"""Cosine similarity with shrinkage, and neighbour tables ``(i, j, sim, rank)``.

Pairs that share no feature have no row; empty tables give no rows. Ids and tokens must not be null.
"""

from __future__ import annotations

from itertools import takewhile
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from recjobs.functions.columns import best, rounded
from recjobs.functions.storage import materialize
from recjobs.operators.prep import l2_normalize

PROFILE_BLOCK = 128  # a longer profile meets itself by blocks of about so many rows
KEYS = 32  # sets of tokens a row, on average, that neighbours by content are looked up by
FIRST_PAIRS = 8  # pairs of the first step, for each neighbour asked for
KEY_BLOCK = 2048  # rows of a key that meet in one group
RARE = 4  # right rows that hold a rare token, for each neighbour asked for


def shrunk(dot: Column, co: Column, shrink: Column, exact: bool = False) -> Column:
    """dot * co / (co + shrink), as it is without shrinkage; rounded unless ``exact``."""
    sim = F.when(shrink > 0, dot * (co / (co + shrink.cast("double")))).otherwise(dot)
    return sim if exact else rounded(sim)


def content_kinds(content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``content(id, attr, token, weight)`` -> ``(id, kind)`` and the content of kinds: rows of equal
    content are one kind, named by its least id, so that similarity is made once a kind."""
    told = content.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("attr", "token", "weight"))).alias("cells"))
    kinds = told.groupBy("cells").agg(F.min("id").alias("kind"))
    members = told.join(kinds, "cells").select("id", "kind")
    return members, kinds.select(F.col("kind").alias("id"), F.explode("cells").alias("x")).select("id", "x.*")


def _kind_dots(content: DataFrame, left: DataFrame | None, right: DataFrame | None) -> DataFrame:
    unit = l2_normalize(content, ["id"], "weight")
    x, y = (unit if ids is None else unit.join(ids, "id", "left_semi") for ids in (left, right))
    x = x.select(F.col("id").alias("i"), "attr", "token", F.col("weight").alias("wi"))
    y = y.select(F.col("id").alias("j"), "attr", "token", F.col("weight").alias("wj"))
    return x.join(y, ["attr", "token"]).groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("dot"), F.count("*").alias("co"))


def _members(members: DataFrame, ids: DataFrame | None) -> DataFrame:
    return members if ids is None else members.join(ids.select("id").distinct(), "id", "left_semi")


def _expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of kinds -> pairs of different rows of them, rows of one kind included."""
    x, y = (m.select(F.col("kind").alias(c), F.col("id").alias(c + "_id")) for m, c in ((left, "i"), (right, "j")))
    both = pairs.join(x, "i").join(y, "j").filter("i_id <> j_id").drop("i", "j")
    return both.withColumnRenamed("i_id", "i").withColumnRenamed("j_id", "j")


def _kinds_of(members: DataFrame) -> DataFrame:
    return members.select(F.col("kind").alias("id")).distinct()


def content_dots(content: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """``(i, j, dot, co)`` of normalised rows that share a feature; ``left`` / ``right`` are tables of
    ids that i / j are restricted to.

    Rows of equal content are compared once and then expanded. Features of few values make heavy join
    keys, so the pair table grows with the square of a feature's kinds: restrict ``left``, and leave
    skewed keys to adaptive join splitting; for neighbours alone take ``content_nearest``.
    """
    members, kinds = content_kinds(content)
    x, y = _members(members, left), _members(members, right)
    dots = _kind_dots(kinds, None if left is None else _kinds_of(x), None if right is None else _kinds_of(y))
    return _expanded(dots, x, y).select("i", "j", "dot", "co")


def _posted(kinds: DataFrame, left: DataFrame | None, right: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each side's kinds as rows ``(id, cells)``. A cell is a token's number of right rows, its number,
    the row's unit weight, and the most that the token can add to a dot product; rarest tokens stand first.

    Tokens are numbered as they are written, so numbers are exact and hold in every later reading."""
    unit = l2_normalize(kinds, ["id"], "weight")
    x, y = (unit if ids is None else unit.join(ids, "id", "left_semi") for ids in (left, right))
    tokens = y.groupBy("attr", "token").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    tokens = materialize(tokens.withColumn("t", F.monotonically_increasing_id()), "tokens")
    cell = F.struct("n", "t", F.col("weight").alias("w"), (F.col("weight") * F.col("most")).alias("top"))
    sides = (side.join(tokens, ["attr", "token"]).groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("cells")) for side in (x, y))
    a, b = (materialize(side, "cells") for side in sides)
    return a, b


def _subsets(rows: DataFrame, r: int) -> DataFrame:
    """``(id, cells, held)``: all choices of r cells of each row, in the order of its cells."""
    out = rows.withColumn("held", F.array().cast("array<int>"))
    for k in range(r):
        after = F.coalesce(F.element_at("held", -1), F.lit(0)) + 1 if k else F.lit(1)
        last = F.size("cells") - (r - k - 1)
        place = F.explode(F.when(after <= last, F.sequence(after, last)).otherwise(F.array().cast("array<int>")))
        out = out.select("id", "cells", "held", place.alias("p")).select("id", "cells", F.concat("held", F.array("p")).alias("held"))
    cells = F.transform("held", lambda p: F.element_at("cells", p))
    return out.withColumn("held", cells).withColumn("key", F.col("held.t"))


def _depth(x: DataFrame, y: DataFrame, k: int) -> int:
    """How many tokens pairs share under a key of the first step: the fewest whose keys make at most
    FIRST_PAIRS pairs a neighbour asked for, among the depths with at most KEYS keys a row on average.
    It is 0 where all pairs that share a token are no more than that."""
    rows = y.select(F.size("cells").alias("m")).groupBy("m").count().collect()  # a row for each length
    total, longest = sum(r["count"] for r in rows), max((r.m for r in rows), default=0)
    depths = list(takewhile(lambda r: r == 1 or sum(comb(row.m, r) * row["count"] for row in rows) <= KEYS * total, range(1, longest + 1)))
    allowed = FIRST_PAIRS * k * x.count()

    def pairs(r: int) -> int:
        a, b = (_subsets(side, r).groupBy(F.xxhash64("key").alias("h")).agg(F.count("*").alias(c)) for side, c in ((x, "a"), (y, "b")))
        return a.join(b, "h").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0

    if not depths or pairs(1) <= allowed:
        return 0
    return next((r for r in depths[1:] if pairs(r) <= allowed), depths[-1])


def _meet(x: DataFrame, y: DataFrame, r: int, only: bool, shrink: int) -> DataFrame:
    """``(i, j, sim)`` of the pairs under keys of r tokens, where the key is the r rarest that the two
    share (and, if ``only``, all of them): no pair is met under two keys.

    A key of many rows is dealt into blocks by its rarest token's rows, and each pair of blocks is a
    group of its own. Few rows make many pairs, so the number of partitions is not left to their bytes."""
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("held")[0]["n"] / KEY_BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    a = x.select(F.col("id").alias("i"), F.col("cells").alias("ci"), "key", own.alias("bx"), every.alias("by"))
    b = _subsets(y, r).select(F.col("id").alias("j"), F.col("cells").alias("cj"), "key", own.alias("by"), every.alias("bx"))
    a, b = (side.repartition(parts, "key", "bx", "by") for side in (a, b))
    shared = F.array_intersect("ci.t", "cj.t")
    both = a.join(b, ["key", "bx", "by"]).withColumn("shared", shared).filter((F.col("shared") if only else F.slice("shared", 1, r)) == F.col("key"))
    weights = F.map_from_arrays("cj.t", "cj.w")
    products = F.transform("ci", lambda c: F.coalesce(c["w"] * weights[c["t"]], F.lit(0.0)))
    dots = both.select("i", "j", F.aggregate(products, F.lit(0.0), lambda s, v: s + v).alias("dot"), F.size("shared").alias("co"))
    return similarities(dots, shrink)


def _most(cells: Column, r: Column | int, shrink: int) -> Column:
    """No pair that shares exactly (a part of) these r cells is more similar."""
    tops = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["top"])
    norm = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["w"] * c["w"]))  # the other row is no longer than 1
    return F.least(tops, norm) * r / (r + F.lit(float(shrink)))


def _nearest_kinds(x: DataFrame, y: DataFrame, first: DataFrame, k: int, shrink: int) -> DataFrame:
    """The k most similar right rows of each left row, ties to the smaller ``first``: what
    ``_kind_dots`` and a cut give, without most of its pairs."""
    depth = _depth(x, y, k)
    found: DataFrame | None = None

    def add(keys: DataFrame, r: int, only: bool) -> None:
        nonlocal found
        met = _meet(keys, y, r, only, shrink).join(first, "j")
        every = met if found is None else met.unionByName(found)
        found = materialize(best(every, "i", "sim", "first", k).select("i", "j", "sim", "first"), "nearest")

    def may_enter(keys: DataFrame, most: Column) -> DataFrame:
        """Keys under which a pair can still be among its row's k best."""
        floor = found.groupBy("i").agg(F.when(F.count("*") == k, F.min("sim")).alias("floor"))
        open_keys = keys.join(floor.withColumnRenamed("i", "id"), "id", "left")
        return open_keys.filter(F.col("floor").isNull() | (most + F.lit(2e-6) >= F.col("floor")))

    whole = _subsets(x, max(depth, 1))
    if depth == 0:
        add(whole, 1, False)
        return found
    if depth > 1:
        add(whole, depth, False)
        for r in range(depth - 1, 0, -1):
            add(may_enter(_subsets(x, r), _most(F.col("held"), r, shrink)), r, True)
        return found
    rare = F.col("held")[0]["n"] <= RARE * k
    add(whole.filter(rare), 1, False)
    # a pair under this key shares it and more frequent tokens only
    rest = F.filter("cells", lambda c: F.struct(c["n"], c["t"]) >= F.struct(F.col("held")[0]["n"].alias("n"), F.col("held")[0]["t"].alias("t")))
    add(may_enter(whole.filter(~rare), _most(rest, F.size(rest), shrink)), 1, False)
    return found


def content_nearest(content: DataFrame, k: int, shrink: int = 0, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """The k most similar rows of each: kinds are cut before they are expanded, and rows after. A row
    among a row's k nearest is of one of its k nearest kinds, and one of that kind's k least ids (the
    row itself aside), ties going to the smaller id.

    Kinds meet under sets of several tokens first, which few share. The least similarity among the best
    found so far then bounds what fewer shared tokens must add up to, so that sets of frequent tokens are
    left out wherever a pair that shares no more can't enter. Rows with fewer than k likely neighbours
    meet all that share a token with them. Weights must not be negative.
    """
    members, kinds = content_kinds(content)
    members, kinds = materialize(members, "members"), materialize(kinds, "kinds")
    x, y = _members(members, left), _members(members, right)
    y = y.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("n") <= k + 1)
    first = y.filter("n = 1").select(F.col("kind").alias("j"), F.col("id").alias("first"))
    sides = _posted(kinds, None if left is None else _kinds_of(x), None if right is None else _kinds_of(y))
    near = _nearest_kinds(*sides, first, k + 1, shrink).select("i", "j", "sim")
    return best(_expanded(near, x, y).select("i", "j", "sim"), "i", "sim", "j", k)


def profile_pairs(ratings: DataFrame, diagonal: bool = False, of_user: list[str] = []) -> DataFrame:  # noqa: B006
    """``(i, j, ri, rj)``: the pairs i < j (or i <= j) of each user's items with their ratings, and the
    columns ``of_user``, which are a user's own (its fold, say).

    Users of more than PROFILE_BLOCK ratings are dealt into blocks, and each pair of blocks is a group
    of its own: a long profile is no hot key, and its rows travel as often as it has blocks.
    """
    blocks = F.ceil(F.count("*") / PROFILE_BLOCK).cast("int").alias("blocks")
    cut = ratings.select("user_id", "item_id", "rating", *of_user).join(ratings.groupBy("user_id").agg(blocks), "user_id")
    block = F.pmod(F.xxhash64("item_id"), "blocks").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.withColumn("block", block).select("user_id", "item_id", "rating", *of_user, "block", every)
    x = cut.select("user_id", *of_user, F.col("block").alias("bx"), F.col("other").alias("by"), F.col("item_id").alias("i"), F.col("rating").alias("ri"))
    y = cut.select("user_id", F.col("other").alias("bx"), F.col("block").alias("by"), F.col("item_id").alias("j"), F.col("rating").alias("rj"))
    return x.join(y, ["user_id", "bx", "by"]).filter("i <= j" if diagonal else "i < j").select("i", "j", "ri", "rj", *of_user)


def rating_dots(ratings: DataFrame, mirror: bool = True) -> DataFrame:
    """``(i, j, dot, co)`` of item columns over common users. Each pair is made once and mirrored."""
    norms = ratings.groupBy("item_id").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    raw = profile_pairs(ratings).groupBy("i", "j").agg(F.sum(F.col("ri") * F.col("rj")).alias("dot"), F.count("*").alias("co"))
    small = F.lit(1e-6)
    ni, nj = norms.select(F.col("item_id").alias("i"), F.col("norm").alias("ni")), norms.select(F.col("item_id").alias("j"), F.col("norm").alias("nj"))
    once = raw.join(ni, "i").join(nj, "j").select("i", "j", (F.col("dot") / ((F.col("ni") + small) * (F.col("nj") + small))).alias("dot"), "co")
    return once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "dot", "co")) if mirror else once


def similarities(dots: DataFrame, shrink: int = 0, exact: bool = False) -> DataFrame:
    """``exact`` leaves the values unrounded: scores then are rounded once, but ranks among equal
    similarities may depend on the order of summation."""
    return dots.select("i", "j", shrunk(F.col("dot"), F.col("co"), F.lit(shrink), exact).alias("sim")).filter("sim > 0")


def nearest(sims: DataFrame, k: int) -> DataFrame:
    """The k most similar j of each i, ties to the smaller id; fewer where there are not so many."""
    return best(sims, "i", "sim", "j", k)


def cut(neighbours: DataFrame, k: int) -> DataFrame:
    """A stored neighbour table cut to a smaller k."""
    return neighbours.filter(F.col("rank") <= k)


def weights_to_neighbours(weights: DataFrame, k: int) -> DataFrame:
    """The k largest weights into each target, as neighbours of it."""
    ranked = best(weights.filter("weight > 0"), "dst_id", "weight", "src_id", k)
    return ranked.select(F.col("dst_id").alias("i"), F.col("src_id").alias("j"), F.col("weight").alias("sim"), "rank")


def as_candidates(neighbours: DataFrame) -> DataFrame:
    """Votes for i of a rating on its neighbour j: the list belongs to the candidate."""
    return neighbours.select(F.col("j").alias("src_id"), F.col("i").alias("dst_id"), F.col("sim").alias("weight"))


def as_weights(neighbours: DataFrame) -> DataFrame:
    """Votes of a rating on i for j: a neighbour table is symmetric in use, its cut is i's."""
    return neighbours.select(F.col("i").alias("src_id"), F.col("j").alias("dst_id"), F.col("sim").alias("weight"))
