"""Analytics over canonical rows; every function is DataFrame in, DataFrame out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, goals, text
from ..functions.access import flag_label

LEAST_PERCENT = 3.0
TOP_AUTHORS, TOP_NODES, TOP_EDGES, PAGE = 20, 30, 20, 25


def with_share(rows: DataFrame, value: str, share: str = "share", digits: int = 6) -> DataFrame:
    """Percentage of the total; the total is one row, joined by broadcast."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(share, F.round(F.col(value) * 100.0 / F.col("_total"), digits)).drop("_total")


def goal_share(rows: DataFrame, formatted: str, order: str, least: float = LEAST_PERCENT) -> DataFrame:
    """code, label, total and share of the percentages at or above ``least``."""
    one = rows.select(F.col(order).alias("_ord"), F.posexplode(goals.lines(F.col(formatted))).alias("_i", "g")).select("_ord", "_i", "g.*").where(F.col("pct") >= least)
    label = F.concat(F.lit("SDG "), "code", F.when(F.col("name") != "", F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise(""))
    sums = one.groupBy("code").agg(F.sum("pct").alias("total"), F.min_by(label, F.struct("_ord", "_i")).alias("label"))
    return with_share(sums, "total")


def access_ring(rows: DataFrame, flag: str) -> DataFrame:
    return with_share(rows.groupBy(flag_label(F.col(flag)).alias("access")).agg(F.count("*").alias("n")), "n")


def type_distribution(rows: DataFrame, kind: str) -> DataFrame:
    """Counts by type; blank is unknown."""
    name = F.coalesce(text.nullify(F.trim(F.col(kind))), F.lit("unknown"))
    return with_share(rows.groupBy(name.alias("type")).agg(F.count("*").alias("n")), "n")


def status_by_month(rows: DataFrame, day: str, status: str, begin: date, end: date) -> DataFrame:
    """Dense month x status grid; months without rows count 0, reversed bounds are swapped."""
    begin, end = sorted((begin, end))
    window = rows.where(dates.month_in(F.col(day), F.lit(begin), F.lit(end)))
    found = window.groupBy(dates.month(F.col(day)).alias("month"), F.coalesce(text.nullify(F.trim(F.col(status))), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    months = F.sequence(F.lit(begin.replace(day=1)), F.lit(end.replace(day=1)), F.expr("interval 1 month"))
    grid = found.select("status").distinct().select("status", F.explode(months).alias("month"))
    return grid.join(found, ["month", "status"], "left").select("month", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def author_access(rows: DataFrame, authors: Column, flag: Column, k: int = TOP_AUTHORS) -> DataFrame:
    """Counts by author and access label of the ``k`` authors with most rows (ties: by name)."""
    one = rows.select(F.explode(authors).alias("author"), flag.alias("access")).where(F.trim("author") != "")
    counts = one.groupBy("author", "access").agg(F.count("*").alias("n"))
    top = counts.groupBy("author").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "author").limit(k)
    return counts.join(F.broadcast(top.select("author")), "author", "left_semi")  # k rows


#: Rows of a table that one task groups, about.
ROWS_PER_TASK = 250_000


def spread(rows: DataFrame, *by: str, size: int | None = None) -> DataFrame:
    """Rows (``size`` of them; counted if not told) dealt by ``by`` to as many tasks as they need, no fewer than a shuffle
    has. What a grouping by these columns holds in one task then does not grow with the table."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-(rows.count() if size is None else size) // ROWS_PER_TASK)), *by)


def gathered(members: DataFrame, row: str, member: str) -> DataFrame:
    """row, ids: the distinct members of each row."""
    return spread(members.select(row, member), row).groupBy(row).agg(F.collect_set(member).alias("ids"))


#: Ids from which a row's pairs are dealt to tasks, and ids of a block of such a row.
HEAVY_IDS, BLOCK_IDS = 512, 256


def pairs(rows: DataFrame, ids: str) -> DataFrame:
    """a, b: the unordered pairs a < b of each row's distinct ids. Generators in turn, so a row's pairs stream
    out and are never held as one array. The ids of a heavy row are cut into blocks; pairs of blocks,
    a few hundred ids each, are dealt to as many tasks as a shuffle has."""
    several = rows.select(F.array_sort(F.array_distinct(ids)).alias("_s")).where(F.size("_s") >= 2)
    left = several.where(F.size("_s") < HEAVY_IDS).select("_s", F.posexplode(F.slice("_s", F.lit(1), F.size("_s") - 1)).alias("_i", "a"))
    light = left.select("a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s") - F.col("_i") - 1)).alias("b"))

    def block(i: str) -> Column:
        return F.slice("_s", F.col(i) * BLOCK_IDS + 1, F.lit(BLOCK_IDS))

    last = F.ceil(F.size("_s") / BLOCK_IDS).cast("int") - 1
    one = several.where(F.size("_s") >= HEAVY_IDS).select("_s", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    both = one.select(block("_i").alias("_x"), "_s", F.explode(F.sequence("_i", "_last")).alias("_j")).select("_x", block("_j").alias("_y"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, F.xxhash64(F.col("_x")[0], F.col("_y")[0], F.element_at("_x", -1), F.element_at("_y", -1)))
    heavy = dealt.select("_y", F.explode("_x").alias("a")).select("a", F.explode("_y").alias("b")).where("a < b")
    return light.unionByName(heavy)


def edges(rows: DataFrame, ids: str) -> DataFrame:
    """a, b, w: in how many rows both ids occur. The pairs are counted first, so that they can be dealt to as many tasks as they need."""
    n = F.size(F.array_distinct(ids)).cast("long")
    made = rows.agg(F.sum(F.when(n > 1, n * (n - 1) / 2)).cast("long")).first()[0] or 0
    return spread(pairs(rows, ids), "a", "b", size=made).groupBy("a", "b").agg(F.count("*").alias("w"))


def _known(labels: DataFrame) -> DataFrame:
    """id, label, and how often the id has it (m)."""
    return labels.where("label is not null").groupBy("id", "label").agg(F.count("*").alias("m"))


def label_edges(members: DataFrame, row: str, labels: DataFrame) -> DataFrame:
    """``relabelled`` of ``edges`` of members (row, id), made the other way round: ids get their labels before the pairs of a
    row are made, so that a task counts pairs of labels and none of ids."""
    ends = spread(members.select(row, "id").join(_known(labels), "id"), row, size=members.count()).groupBy(row).agg(F.collect_set(F.struct("id", "label", "m")).alias("ends"))
    met = pairs(ends, "ends").where("a.id <> b.id and a.label <> b.label")
    return met.groupBy(F.least("a.label", "b.label").alias("a"), F.greatest("a.label", "b.label").alias("b")).agg(F.sum(F.col("a.m") * F.col("b.m")).alias("w"))


def label_degrees(members: DataFrame, row: str, labels: DataFrame) -> DataFrame:
    """``weighted_degree`` of ``label_edges``, without a pair: of a row's n labelled ids, the k of one label meet n - k others
    each. Pairs of an id with itself, under another label, do not count."""
    known = _known(labels).withColumn("own", F.col("m") * (F.sum("m").over(W.partitionBy("id")) - F.col("m")))
    ends = spread(members.select(row, "id").join(known, "id"), row, size=members.count()).distinct()
    one = ends.groupBy(row, "label").agg(F.sum("m").alias("k"), F.sum("own").alias("own"))
    met = F.col("k") * (F.sum("k").over(W.partitionBy(row)) - F.col("k")) - F.col("own")
    return one.select("label", met.alias("met")).where("met > 0").groupBy("label").agg(F.sum("met").alias("degree"))


def relabelled(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels (id, label): ends with one label merge, loops go."""
    a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    return edge.join(a, "a").join(b, "b").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def weighted_degree(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("a", "b")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("degree"))


def top_nodes(edge: DataFrame, k: int = TOP_NODES, query: str = "", origins: list[str] | None = None) -> DataFrame:
    """The ``k`` labels of greatest degree among those that match ``query``, and the origins in any case."""
    return top_degrees(weighted_degree(edge), k, query, origins)


def top_degrees(degree: DataFrame, k: int = TOP_NODES, query: str = "", origins: list[str] | None = None) -> DataFrame:
    """``top_nodes`` of degrees (label, degree)."""
    kept = F.col("label").isin(origins or [])
    top = degree.where(labels_matching(F.col("label"), query) | (kept if query.strip() else F.lit(False))).orderBy(F.desc("degree"), "label").limit(k)
    return top.unionByName(degree.where(kept)).distinct() if origins else top


def between(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (label)."""
    return edge.join(nodes.select(F.col("label").alias("a")), "a", "left_semi").join(nodes.select(F.col("label").alias("b")), "b", "left_semi")


def coverage(rows: DataFrame, ids: str) -> DataFrame:
    """One row: publications with at least two distinct institutions, and all."""
    return rows.agg(F.count_if(F.size(F.array_distinct(ids)) >= 2).alias("eligible"), F.count("*").alias("total"))


def first_named(rows: DataFrame, identifier: str, name: str, order: str) -> DataFrame:
    """id, label: the first non-empty name that each id has."""
    told = F.trim(F.coalesce(name, F.lit(""))) != ""
    return rows.groupBy(F.col(identifier).alias("id")).agg(F.min_by(F.when(told, F.col(name)), F.when(told, F.col(order))).alias("label"))


def with_days(rows: DataFrame, day: str, year: str, to: str = "pub_day") -> DataFrame:
    """Rows with their day; only where no row at all has a date, the starts of their years instead."""
    told = F.broadcast(rows.agg(F.count(dates.lower_bound(F.col(day))).alias("_dated")))  # one row
    start = F.try_to_date(F.col(year).cast("string"), "yyyy")
    return rows.crossJoin(told).withColumn(to, F.when(F.col("_dated") > 0, dates.lower_bound(F.col(day))).otherwise(start)).drop("_dated")


def labels_matching(labels: Column, query: str) -> Column:
    """A label holds any of the comma-separated terms; a blank query matches all."""
    terms = [t.strip().lower() for t in query.split(",") if t.strip()]
    return F.lit(True) if not terms else F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(labels), t))


def edge_groups(edge: DataFrame, origins: list[str], least: int = 1, k: int = TOP_EDGES) -> DataFrame:
    """Primary edges (an end is an origin) and the ``k`` heaviest secondary ones (both ends are
    neighbours of origins, and no origins), with their kind."""
    at = F.col("a").isin(origins), F.col("b").isin(origins)
    primary = edge.where(at[0] | at[1])
    near = primary.select(F.explode(F.array("a", "b")).alias("x")).where(~F.col("x").isin(origins)).distinct()
    second = edge.where((F.col("w") >= least) & ~at[0] & ~at[1]).join(near.withColumnRenamed("x", "a"), "a", "left_semi").join(near.withColumnRenamed("x", "b"), "b", "left_semi")
    return primary.select("a", "b", "w", F.lit("primary").alias("kind")).unionByName(second.orderBy(F.desc("w"), "a", "b").limit(k).select("a", "b", "w", F.lit("secondary").alias("kind")))


def newest(rows: DataFrame, day: str, key: str, limit: int) -> DataFrame:
    """Top rows by text date, then key, both descending."""
    return rows.orderBy(F.desc(day), F.desc(key)).limit(limit)


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 0) with row numbers from the start of all rows."""
    first = number * size
    top = rows.orderBy(*order).limit(first + size)  # bounded by the page asked for
    return top.withColumn("row", F.row_number().over(W.orderBy(*order)).cast("long")).where(F.col("row") > first)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` per key, by aggregation (no sort of a group)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
